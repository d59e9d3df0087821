"""Every stage of the pipeline on a small corpus, against plain versions."""

import random

import pytest

import corpus_pipeline
from moraine.llm import mixing, pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_id", "_score", "toxic", "copy", "_seed", "seed", "_text", "_key", "rate", "mix_source", "mix_kept", "pii_base", "score", "score_hits"]


def corpus():
    dice = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ki") for b in ("lun", "mer", "sot", "vig") for c in ("a", "en", "is", "o", "um")]
    say = lambda n: " ".join(dice.choice(words) for _ in range(n))
    base, texts = say(200), {}
    for k in range(150):
        texts[k] = f"{say(20)} {dice.choice(['vileness', 'vilenessy'])} {say(20)}" if k % 3 == 0 else say(45)
    texts |= {200: base, 201: base, 202: base.replace(base.split()[50], "other", 1), 203: say(60) + " mail ann.b@site.org or 10.1.2.3", 204: None, 205: "", 206: None, 207: say(9000)}
    rows = [(i, t, dice.choice(["en", "fr", None]), dice.choice("aab"), len(t or "")) for i, t in texts.items()]
    rows += [(None, "no id at all", "en", "a", 12), rows[0], rows[1]]
    return [(*r, *[7] * (len(COLUMNS) - 5)) for r in rows], {i for i in range(150) if i % 3 == 0}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows, toxic = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in COLUMNS[5:])).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    """Each stage takes what its predecessor kept, works on all of it, and keeps clean documents."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "pii", "mixing", "sentencepiece"]
    _, toxic = corpus()
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        kept[name] = [r.asDict() for r in docs.collect()]
        assert all(r[c] == 7 for r in kept[name] for c in COLUMNS[5:])
        if name == "mixing":
            rows = mixing.corpus_mix(before.select("doc_id", "text", "lang", "source")).select("doc_id", "mix_kept").collect()
            assert sorted(str(r["doc_id"]) for r in rows if r["mix_kept"]) == sorted(str(r["doc_id"]) for r in kept[name])
            assert 0 < len(kept[name]) < len(rows)
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    every = {r[0] for r in corpus()[0]}
    assert ids["toxicity"] == every - toxic  # those without a label too

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept["toxicity"] if r["doc_id"] is not None}
    copies = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {201, 202} <= copies and ids["minhash"] == ids["toxicity"] - copies
    assert ids["pii"] == ids["minhash"]
    texts = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert texts[203].endswith("[ip]") and "[email]" in texts[203] and texts[204] is None and texts[205] == ""
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["pii"])
    assert {i: t for i, t in texts.items() if i != 203} == {r["doc_id"]: r["text"] for r in kept["minhash"] if r["doc_id"] != 203}
    tool = pieces.Sampler(corpus_pipeline.MODEL)
    last = {r["doc_id"]: r for r in kept["sentencepiece"]}
    assert last.keys() == ids["mixing"] and all(r["lossless"] and tool.decode(r["pieces"]).decode() == (r["text"] or "") for r in last.values())
    rows = lambda f: sorted(map(str, f.collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(docs)  # run() is the stages in order


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
