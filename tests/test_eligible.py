"""Elements that leave the parser where features read the selected ones alone."""

from pyspark.sql import functions as F

from crawlsift.operators import html

PAGE = (
    "<html><body><main><a href='/x' target='_blank' rel='nofollow'><img src='http://a.b/c.png'></a><p>text <b>x</b></p><a href='/y' target='t'><img src='/d.jpg'><span style='display:block'></span></a>"
    "<a href='/z' rel='x'></a><iframe src='http://f.g/'></iframe><noscript><iframe src='/n'></iframe></noscript><div style='display:none'><iframe src='/h'></iframe></div><div src='/s' style='background-image: url(/q)'></div></main></body></html>"
)


def test_fewer_elements_and_the_same_selected(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    every, few = html.elements(pages), html.elements(pages, eligible=True)
    of = lambda rows: sorted((r.number, r["class"], str(r)) for r in html.selected(rows).collect())
    assert of(few) == of(every) and len(of(few)) >= 4
    assert few.count() <= 7 < every.where(F.col("id") == 1).count()
