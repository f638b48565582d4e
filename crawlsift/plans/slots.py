"""Correspondence of slots as a query: a frame put into each page, and what stands in its place in another load of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.functions import urls
from crawlsift.operators import html
from crawlsift.sources.stored import stored

#: The slot's attributes in the two loads, by page_id: the same, one more word, others, blocked, and behind one more element.
FORMS = ("same", "more", "other", "blocked", "moved", "gone")


def _repeat(text: Column | str, n: Column) -> Column:
    return F.repeat(F.lit(text) if isinstance(text, str) else text, n.cast("int"))


def page_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a slot of frames at the end of their article (control), and with images in it (variant): the images and
    frames of the variant that stand where the control had frames, by party."""
    n, host = F.col("page_id"), urls.host(F.col("url"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.contains("html", F.lit("<article>")) & F.contains("html", F.lit("</article>"))).select("page_id", "html", host.alias("site"))
    p = p.withColumn("word", urls.domain_word(F.col("site")))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (n % len(FORMS) + 1).cast("int"))
    source = F.when(n % 4 == 0, F.concat(F.lit("http://"), "site", F.lit("/f"))).otherwise(F.lit("http://0.1/f"))
    control = F.concat(F.lit('<i></i><div class="w" id="s1">'), _repeat(F.concat(F.lit('<iframe src="'), source, F.lit('"></iframe>')), n % 3 + 1), F.lit("</div></article>"))
    attrs = F.when(form == "same", 'class="w" id="s1"').when(form == "more", 'class="v  w" id="s1"').when(form == "other", 'class="x" id="y"').when(form == "blocked", 'class="w" id="s1" abp-blocked-element="true"').otherwise('class="w" id="s1"')
    before = F.when(form == "moved", "<i></i><i></i>").otherwise("<i></i>")
    inner = F.concat(_repeat('<p><img src="q"></p>', n % 14), _repeat('<img src="s" width="9">', n % 2), _repeat("<iframe></iframe>", F.floor(n / 6) % 2))
    variant = F.when(form == "gone", F.lit("</article>")).otherwise(F.concat(before, F.lit("<div "), attrs, F.lit(">"), inner, F.lit("</div></article>")))
    put = lambda slot: F.concat(F.substring_index("html", "</article>", 1), slot)
    loads = p.withColumn("load", F.explode(F.array(F.struct(F.lit(True).alias("control"), put(control).alias("html")), F.struct(F.lit(False).alias("control"), put(variant).alias("html"))))).select("page_id", "site", "word", "load.*")
    rows = stored(html.elements(loads), "slots")
    return html.corresponding(rows.where("control").drop("control"), rows.where("not control").drop("control"), ["page_id"], "site", "word")


SLOTS_SQL = f"""WITH p AS (
  SELECT page_id, {list(FORMS)!r}[page_id % {len(FORMS)} + 1] AS f, page_id % 14 AS images, page_id // 6 % 2 AS frames, page_id % 3 + 1 AS held, page_id % 4 = 0 AS own
  FROM pages WHERE contains(html, '<article>') AND contains(html, '</article>')
), c AS (
  SELECT *, f IN ('same', 'more', 'other') AS met, CASE WHEN images <= 10 OR images < 2 * held THEN images ELSE 0 END AS i FROM p
)
SELECT page_id, CASE WHEN met AND own THEN i ELSE 0 END AS corresp_img_fp, CASE WHEN met AND own THEN frames ELSE 0 END AS corresp_iframe_fp,
  CASE WHEN met AND NOT own THEN i ELSE 0 END AS corresp_img_tp, CASE WHEN met AND NOT own THEN frames ELSE 0 END AS corresp_iframe_tp FROM c"""

QUERIES = {"page_slots": page_slots}
ORACLES = {"page_slots": SLOTS_SQL}
