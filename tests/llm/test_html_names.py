"""Pages whose article or main isn't, or isn't all of, the main text."""

from lattica.llm import html_extract as H


def texts(spark, rows, most=H.MAX_TEMPLATES):
    pages = spark.createDataFrame([(i, f"http://h.example.org/{i}", s) for i, s in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in H.extract(pages, most).orderBy("page_id").collect()]


def test_teaser_in_an_article(spark):
    own = [f"Story number {i} has words of its own {i * 7}.\n\nThe second part of story {i} goes on." for i in range(12)]
    for card in ("<article><p>Read on {0}</p></article>", "<div class=cards><article><h3>Card {0}</h3><p>More of {0}</p></article></div>"):
        pages = [f"<html><body><div class=story>{''.join(f'<p>{p}</p>' for p in x.split(chr(10) * 2))}</div>{card.format(i * 13)}</body></html>" for i, x in enumerate(own)]
        for most in (H.MAX_TEMPLATES, 0):
            assert texts(spark, pages, most) == own


def test_fixed_text_in_main(spark):
    pages = [f"<html><body><main><div class=box><p>About this house and its people</p></div><div class=story><p>The story of day {i} is {i * 7} words long.</p></div></main></body></html>" for i in range(8)]
    assert texts(spark, pages) == [f"The story of day {i} is {i * 7} words long." for i in range(8)]


def test_rare_paths_of_articles(spark):
    pages = [f"<html><body><div class=list><p>Seen {i * 31} times</p></div><article class='c{chr(97 + i)}'><h1>Head {i}</h1><div class=body><p>Story {i} is long enough to be the main text of the page.</p></div></article></body></html>" for i in range(8)]
    assert texts(spark, pages) == [f"Head {i}\n\nStory {i} is long enough to be the main text of the page." for i in range(8)]
