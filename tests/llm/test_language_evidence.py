"""Evidence that must not be lost: many languages, and a host with and without a domain."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import langid


def test_every_declared_language_is_known(spark):
    """More languages than any fixed list: each is identified in texts that declare none."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for k in range(132)}
    text = lambda k: " ".join(rng.choices(words[k], k=60))
    rows = [(n * 10 + j, text(k), k if j < 3 else None, f"s{rng.randrange(50)}") for n, k in enumerate(words) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identified(langid.of_documents(docs), ["doc_id"]).collect()}
    assert all(got[n * 10 + 3]["language"] == k and got[n * 10 + 3]["accepted"] for n, k in enumerate(words))
    assert langid.accepted_documents(docs).count() == len(rows)


@pytest.mark.parametrize("order", [1, -1])
def test_host_of_documents_and_pages(spark, order):
    """Rows of one host count together, whether they name a domain or not."""
    es, en = "el perro come en la casa grande de su amigo todos los dias ", "the quick brown fox jumps over the lazy dog near this old house "
    docs = spark.createDataFrame([(k, es * 5, "es", "example.com") for k in range(40)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(k, f"https://example.com/{k}", f"<html lang='en'><body>{en * 5}</body></html>") for k in range(60)], "page_id long, url string, html string")
    parts = [langid.of_documents(docs).select("_text", "_declared", "_suffix", "_host", "_domain"), langid.of_pages(pages).select("_text", "_declared", "_suffix", "_host", "_domain")][::order]
    rows = parts[0].unionByName(parts[1])
    known = langid.languages(rows)
    scored = rows.select("_declared", "_suffix", "_domain", "_host", langid.scores(langid.text_model(rows, known)).alias("_ll"))
    hosts = langid.Evidence(scored, known).host.where(F.col("_k2") == "example.com").collect()
    assert len(hosts) == 1 and known == ["en", "es", "und"]
    assert [round(x) for x in hosts[0]["_n"]] == [60, 40, 0]
