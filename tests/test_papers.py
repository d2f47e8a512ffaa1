"""Records and PDFs of papers from canned answers."""

from pyspark.sql import functions as F

from meridia.sources import papers
from meridia.sources.http import FetchPolicy

ENTRY = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title>{}</feed>"""
PAPER = """<entry><id>http://arxiv.org/abs/{0}v3</id><updated>2024-02-01T10:00:00Z</updated><published>2024-01-01T09:00:00Z</published><title>Of
 things &amp; more</title><summary> Said. </summary><author><name>A B</name></author><author><name>C  D</name></author>
<link href="http://arxiv.org/abs/{0}v3" rel="alternate" type="text/html"/>{1}
<arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="q-fin.ST"/><category term="q-fin.ST"/><category term="cs.LG"/></entry>"""
PDF = '<link title="pdf" href="http://arxiv.org/pdf/{}v3" rel="related" type="application/pdf"/>'


def transport(url, policy):
    name = url.rsplit("=", 1)[-1]
    if "/pdf/" in url:
        return (404, {}, b"", url) if "2401.00004" in url else (200, {"content-type": "application/pdf"}, b"%PDF " + url.encode(), url + ".final")
    body = {"2401.00001": PAPER.format(name, PDF.format(name)), "2401.00002": "", "2401.00003": PAPER.format(name, ""), "2401.00004": PAPER.format(name, PDF.format(name))}.get(name)
    return (200, {"content-type": "application/atom+xml"}, ENTRY.format(body).encode(), url) if body is not None else (500, {}, b"", url)


def test_arxiv_papers(spark):
    ids = ["arXiv:2401.00001", "https://arxiv.org/abs/2401.00001v3", "2401.00002", "2401.00003", "2401.00004", "2401.00005", "nothing", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "nth int, id string")
    got = {r["nth"]: r for r in papers.arxiv_papers(df, policy=FetchPolicy(attempts=1, spacing=0), transport=lambda u, p: transport(u.replace("2401.00001v3", "2401.00001") if "query" in u else u, p)).collect()}
    one = got[0]
    assert (one["arxiv_id"], one["title"], one["authors"], one["abstract"], one["error"]) == ("2401.00001v3", "Of things & more", ["A B", "C D"], "Said.", None)
    assert (one["primary_category"], one["categories"], bytes(one["body"])[:5], one["resolved_uri"]) == ("q-fin.ST", ["q-fin.ST", "cs.LG"], b"%PDF ", "http://arxiv.org/pdf/2401.00001v3.final")
    assert str(one["published_at"]) == "2024-01-01 09:00:00" and one["updated_at"] > one["published_at"] and got[1]["arxiv_id"] == "2401.00001v3"
    assert [got[n]["error"] for n in range(2, 8)] == ["no record", "no address of a PDF", "PDF: status 404", "record: status 500", "no identifier", "no identifier"]


def test_answers_that_are_no_xml(spark):
    df = spark.createDataFrame([("u", bytearray(b"<feed><entry>")), ("v", bytearray(b"plain")), ("w", None)], "url string, body binary")
    assert [r["error"] for r in papers.arxiv_records(df).orderBy("url").collect()] == ["no record"] * 3


def test_sources_of_papers(spark):
    """What was fetched goes on as source revisions."""
    got = papers.arxiv_papers(spark.createDataFrame([("2401.00001",)], "id string"), policy=FetchPolicy(attempts=1, spacing=0), transport=transport)
    src = papers.acquire(got.withColumn("kind", F.lit("arxiv")).withColumn("uri", F.col("pdf_url"))).first()
    assert src["error"] is None and src["arxiv_id"] == "2401.00001v3" and str(src["available_at"]) == "2024-02-01 10:00:00"
