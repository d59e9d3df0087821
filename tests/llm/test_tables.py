"""Queries on the given tables: text of pages against a plain reading, toxicity on held-out labels."""

import html
import re

import pytest

from moraine.llm.queries import QUERIES

DATA = "/root/testdata"


def test_pages_read_plainly(spark):
    """All pages of this table are an article between site lines; its text by plain substitutions."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op4_html"](spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == len(pages) and sum(r["n_shared"] > 0 for r in rows) > 0
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        body = re.sub(r"<!--.*?-->|</?(?:b|a|i|em|strong|span)\b[^>]*>|<br\s*/?>", lambda m: "" if "br" not in m[0] else " ", body, flags=re.S)
        body = " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", body)).split())
        assert r["text"].split() == body.split() and r["n_chars"] == len(r["text"])


def test_toxicity_on_held_out_labels(spark):
    scored = QUERIES["op6_toxicity"](spark, f"{DATA}/sf0.1").where("held_out")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").where("toxic is not null").select("doc_id", "toxic").distinct()
    rows = [(r["score"], r["toxic"]) for r in scored.join(labels, "doc_id").collect()]
    good, bad = ([s for s, y in rows if y == k] for k in (0, 1))
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    caught, false = sum(b >= 0.5 for b in bad) / len(bad), sum(g >= 0.5 for g in good) / len(good)
    assert len(bad) > 50 and len(good) > 500
    assert area > 0.95 and caught > 0.85 and false < 0.01, (area, caught, false)


@pytest.mark.parametrize("name", ["op3_top_k", "op7_near_vectors"])
def test_query_equals_sql(spark, name):
    import duckdb

    from moraine.llm.queries import SQL

    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/sf0.001/embeddings.parquet'")
    got, want = QUERIES[name](spark, f"{DATA}/sf0.001"), db.sql(SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
