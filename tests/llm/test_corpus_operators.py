"""Corpus operators on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing
columns, against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import embeddings, html, minhash, mixing, pieces, pii, suffix, tokens, toxicity
from moraine.llm.queries import PATTERN, QUERIES, SQL, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, stream int, rep long, component long, key string, score double"
EXTRA = (7, 7, 7, 7, "k", 0.5)


def corpus():
    dice = random.Random(11)
    words = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda"]
    say = lambda n: " ".join(dice.choice(words) for _ in range(n))
    base, passage = say(120), say(70)
    rows = [(None, "no id " + passage), (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, base), (6, base), (7, base + " tail"), (8, say(30) + passage + say(30)), (9, passage + say(10)), (10, say(3000)), (11, "x" * 4000), (12, "ab" * 60), (3, "one")]
    rows += [(20 + k, re.sub(r"\balpha\b", "omega", base, count=k % 5)) for k in range(12)] + [(40 + k, say(60)) for k in range(12)]
    return [(i, t, dice.choice(["en", None]), dice.choice("ab"), None if t is None else len(t), *EXTRA) for i, t in rows]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_repeated_passages(documents):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeated(documents, pack=5000).collect() if r["doc_id"] is not None)
    texts = sorted(((r[0], (r[1] or "").encode()) for r in corpus() if r[0] is not None), key=lambda r: r[0])
    seen, want = {}, []
    for i, b in texts:
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert sum(w[2] for w in want) > 1000


def components(n, links):
    at = {i: i for i in n}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            changed |= at[a] != low or at[b] != low
            at[a] = at[b] = low
    return at


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(documents, words):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents, words=words, block=5).collect() if r["doc_id"] is not None}
    sets = {}
    for i, t, *_ in corpus():
        if i is not None:
            w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = components(sets, links)
    assert got == {(i, len(s), low[i], low[i] == i) for i, s in sets.items()}
    assert len(links) > 20


def test_personal_data(documents, spark):
    text = "Mail bob.x@ex-a.org, +44 (20) 7946-0958 or 10.0.0.255. Card 4111 1111 1111 1111; not 10.0.0.256, 4111111111111112, +12. é😀 a@b.c"
    long = "1" * 20_000 + " " + "a.b" * 10_000 + "@x" + ".y" * 10_000
    rows = [(1, text, 5), (2, None, 5), (2, None, 5), (3, "", 5), (None, text, 5), (4, long, 5)] + [(10 + k, "ring Zaphod at 77.1.2.3 today", 5) for k in range(4)] + [(20 + k, f"today is {k}", 5) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pii_base int").withColumns({c: F.col("pii_base") for c in ("_text", "_key", "row", "_terms", "_found")})
    found = pii.detect(frame)
    assert found.columns == ["doc_id", "text", "_text", "_key", "row", "_terms", "_found", "pii_base", "pii_terms"]
    assert {tuple(r) for r in found.select("_text", "_key", "row", "_terms", "_found").distinct().collect()} == {(5,) * 5}
    by = {r["doc_id"]: r for r in pii.digest(found).collect()}
    assert by[1]["spans"] == by[None]["spans"]
    kinds = {k: re.compile(p) for k, p in [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]}
    starts = [(m.start(), m.end()) for m in kinds["email"].finditer(text)]
    assert [tuple(map(int, s.split(":")[1:])) for s in by[1]["spans"].split(",") if s.startswith("email")] == starts
    assert (by[1]["n_email"], by[1]["n_ip"], by[1]["n_card"], by[1]["n_phone"]) == (2, 1, 1, 1)
    assert by[2]["spans"] == by[3]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[4]["n_email"] == 1
    assert by[10]["spans"] == "term:0:4,term:5:11,ip:15:23"  # these words are seen with the address only
    clean = {r["doc_id"]: r["c"] for r in found.select("doc_id", pii.sanitised(F.col("text"), F.col("pii_base"), F.col("pii_terms")).alias("c")).collect()}
    assert clean[10] == "  at [ip] today" and clean[2] == "" and clean[20] == "today is 0"
    assert pii.digest(pii.detect(frame.limit(0))).count() == 0


def test_terms_of_rare_values(spark):
    texts = ["Write Trillian at t@heart.org"] * 2 + [f"Beeblebrox has n{k}@zaphod.org" for k in range(4)] + [" ".join(["lone@x.org", *(f"word{chr(97 + k)}" * 2 for k in range(26))])]
    frame = spark.createDataFrame([*enumerate(texts + [f"today is {k}" for k in range(300)])], "doc_id int, text string")
    spans = {r["doc_id"]: [t for t in r["spans"].split(",") if t.startswith("term")] for r in pii.digest(pii.detect(frame)).collect()}
    assert spans[0] == spans[1] == ["term:0:5", "term:6:14"]  # a value of two documents
    assert all(spans[k] == ["term:0:10"] for k in range(2, 6))  # values of one document, by their domain
    assert spans[6] == [] and spans[7] == []  # met once: no more than chance


def test_terms_anywhere(spark):
    held = "Slartibartfast " + "of it " * 30 + "is at s@fjord.net, and " + "so " * 40 + "SLARTIBARTFAST"
    frame = spark.createDataFrame([*enumerate([held] * 4 + ["Ask Slartibartfast"] + [f"today is {k}" for k in range(300)])], "doc_id int, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(frame)).collect()}
    assert spans[0] == spans[3] == f"term:0:14,email:201:212,term:{len(held) - 14}:{len(held)}"  # far from the address
    assert spans[4] == "term:4:18" and spans[5] == ""  # and without one


def test_terms_are_generalised(spark):
    texts = ["the Marvinbot is at m@heart.org"] * 4 + ["marvinbot there"] * 8 + ["zyxinbot is at z@ship.org"] * 4 + ["zyxinbot there"] * 8 + [f"so marvelous {k}" for k in range(60)] + [f"today is {k}" for k in range(300)]
    found = pii.detect(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"))
    clean = {r["doc_id"]: r["c"] for r in found.select("doc_id", pii.sanitised(F.col("text"), F.col("pii_base"), F.col("pii_terms")).alias("c")).collect()}
    assert clean[0] == "the marv* is at [email]" and clean[4] == "marv* there"  # a beginning that many documents have
    assert clean[12] == "[term] is at [email]" and clean[24] == "so marvelous 0" and clean[84] == "today is 0"


def test_terms_by_brute_force(spark):
    """Spans of terms from document frequencies in plain loops."""
    dice = random.Random(13)
    words = ["".join(dice.choice("abcdeilmnorst") for _ in range(dice.randrange(4, 8))) for _ in range(60)]
    texts = []
    for k in range(260):
        own = [words[min(int(dice.expovariate(0.06)), 59)] for _ in range(6)]
        if k % 13 == 0:
            own += [f"a{k % 3}@site{k % 2}.org", words[50 + k % 3]]
        texts.append(" ".join(own))
    level, generalise = 0.05, 0.6
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), generalise=generalise, level=level)).collect()}
    held = [({w for w in re.findall(r"[a-z]{4,}", re.sub(r"\S+@\S+", " ", t))}, {m for a, b in re.findall(r"(\S+)@(\S+)", t) for m in (f"{a}@{b}", b)}) for t in texts]
    n_term, n_entity, n_both = ({} for _ in range(3))
    for own, entities in held:
        for w in own:
            n_term[w] = n_term.get(w, 0) + 1
            for e in entities:
                n_both[w, e] = n_both.get((w, e), 0) + 1
        for e in entities:
            n_entity[e] = n_entity.get(e, 0) + 1
    n, found = len(texts), set()
    for (w, e), both in n_both.items():
        mean, ic = n_term[w] * n_entity[e] / n, math.log(n / n_entity[e])
        pmi = math.log(n * both / (n_term[w] * n_entity[e]))
        chance = both * math.log(mean / both) + both - mean - 0.5 * math.log(2 * math.pi * both) - math.log(1 - mean / (both + 1)) if mean < both else 0
        if pmi >= generalise * ic and chance <= math.log(level / len(n_term)):
            found.add(w)
    assert found
    for i, t in enumerate(texts):
        mail = [m.span() for m in re.finditer(r"\S+@\S+", t)]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z]{4,}", t) if m[0] in found and not any(a <= m.start() < b for a, b in mail)]
        assert [s for s in got[i].split(",") if s.startswith("term")] == want


def test_toxicity(spark):
    dice = random.Random(3)
    words = [f"w{k}rd{k}" for k in range(60)]
    say = lambda n: " ".join(dice.choice(words) for _ in range(n))
    bad = [f"{say(20)} {dice.choice(['vileness', 'grubbo' + dice.choice('xyzuv')])} {say(20)}" for _ in range(80)]
    train = spark.createDataFrame([(t, 1) for t in bad] + [(say(40), 0) for _ in range(300)] + [(None, 1), ("x", None)], "text string, label int")
    model = toxicity.fit(train)
    assert any(p.startswith("vilen") for p in model.entries) and "grubbo" in model.entries
    rows = [(1, f"{say(200)} V1leness {say(100)}"), (2, f"a grubbow {say(5)}"), (3, say(100)), (4, None), (5, ""), (6, "vıleness"), (7, "viIenesss grub")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit("old")), model).collect()}
    assert min(got[1], got[2], got[6]) >= 0.5 > max(got[3], got[4], got[5], got[7])
    empty = toxicity.fit(train.limit(0))
    assert toxicity.score(spark.createDataFrame(rows, "doc_id int, text string"), empty).agg(F.max("score")).first()[0] < 0.01
    model.exceptions = {"a grubbow"}
    again = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert again[2] < 0.5


def test_exceptions_of_long_texts(spark):
    dice = random.Random(5)
    say = lambda n: " ".join(f"w{dice.randrange(9000)}rd" for _ in range(n))
    many = " ".join(f"a{chr(97 + k // 26)}{chr(97 + k % 26)} vileness" for k in range(100))  # more phrases than 64, and before the last
    bad = [f"{say(20)} {dice.choice('kmp')}ome vileness {say(20)}" for _ in range(80)] + [f"{say(9)} {many} zzz vileness" for _ in range(20)]
    train = [(t, 1) for t in bad] + [(say(40), 0) for _ in range(300)] + [(f"{say(40)} zzz vileness", 0) for _ in range(3)] + [(f"{say(40)} zzy vileness", 0) for _ in range(3)]
    model = toxicity.fit(spark.createDataFrame(train, "text string, label int"))
    assert any(p.startswith("vil") for p in model.entries)
    assert "zzy vileness" in model.exceptions and "zzz vileness" not in model.exceptions


def test_pages(spark):
    site = lambda body: f"<div>Site name here</div><div>{body}</div><div>All rights kept</div>"
    rows = [
        (1, "https://h.org/a/1", site("First page says this and that")), (2, "https://h.org/a/2", site("Second page speaks of other things")),
        (3, "https://h.org/b/9", site("Third page in another folder")), (4, None, "<article><p>x &amp; y</p></article>"), (5, "http://h.org/c", None), (5, "http://h.org/c", None), (6, "weird", ""),
    ]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[1]["text"] == "First page says this and that" and got[2]["text"] == "Second page speaks of other things"
    assert got[4]["text"] == "x & y" and got[5]["text"] == "" and got[6]["n_chars"] == 0
    assert html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_lone_pages(spark):
    site = lambda body: f"<div>Site name here</div><div>{body}</div><div>All rights kept</div>"
    rows = [(1, "https://h.org/a/1", site("First page says this and that, at length")), (2, "https://h.org/a/2", site("Second page speaks of other things, at length")), (3, "https://h.org/b/9", site("The one page of its folder, with text of its own"))]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "The one page of its folder, with text of its own" and got[3]["n_shared"] == 2


def test_pages_by_brute_force(spark):
    """Every page against its nearest differing page on the host, on random sites without articles."""
    dice = random.Random(12)
    say = lambda: f"own {dice.randrange(10**6)}"
    rows = []
    for host in ("one.org", "two.org", "three.org", "lone.org"):
        site = [f"{host} {w}" for w in ("top", "menu", "foot", "rights")]
        for k in range({"one.org": 160, "lone.org": 1}.get(host, 15)):
            body = [site[0], *[say() for _ in range(dice.randrange(4))], *dice.sample(site[1:], dice.randrange(4)), "shared"]
            rows.append((len(rows), f"https://{host}/{dice.choice(['a', 'b', 'b/c'])}/{k % 40}", "".join(f"<div>{x}</div>" for x in body)))
            if dice.random() < 0.2:
                rows.append((len(rows), rows[-1][1] + dice.choice(["", "0"]), rows[-1][2]))  # a copy
    rows += [(len(rows) + k, "https://long.org/" + "x" * 40_000 + c, f"<p>{c}</p><p>site</p>") for k, c in enumerate("ab")]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)).collect()}
    contents: dict = {}
    for i, url, page in rows:
        host, path = re.match(r"https://([^/]*)(.*)", url).groups()
        contents.setdefault((host, page), []).append(path)
    changed = 0
    for i, url, page in rows:
        host, lines = url.split("/")[2], [t for t, _ in html.lines(page)]
        path = min(contents[host, page])
        rest = [(min(p), x) for (h, x), p in contents.items() if h == host and x != page]
        if not rest:
            assert got[i] == (" ".join(lines), 0)
            continue
        near = lambda p: len(__import__("os").path.commonprefix([path, p]))
        best = max(near(p) for p, _ in rest)
        wanted = set()
        for p, x in rest:
            if near(p) == best:  # ties go by order
                gone = set(html.aligned([*map(hash, lines)], [hash(t) for t, _ in html.lines(x)]))
                wanted.add((" ".join(t for k, t in enumerate(lines) if k not in gone), len(gone)))
        assert got[i] in wanted
        changed += got[i][1] > 0
    assert changed > 200 and len(got) == len(rows)


@pytest.fixture(scope="module")
def vectors(spark):
    dice = np.random.default_rng(8)
    x = dice.standard_normal((70, 8))
    x = np.concatenate([x, x[:20], x[:20] * 2, x[20:40] + 0.05 * dice.standard_normal((20, 8))]).round(3)
    rows = [(int(i), [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [math.nan] * 8, 1), (203, [None] * 8, 1), (204, [], 1), (205, [1.0], 1), (206, [math.inf] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int"), rows


def test_near_vectors(vectors):
    frame, rows = vectors
    good = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    low = components({i for i, *_ in rows}, links)
    want = {(i, sum(i in p for p in links), low[i], low[i] == i) for i, *_ in rows}
    assert {tuple(r) for r in embeddings.near_duplicates(frame, block=7, miss=1e-9).collect()} == want
    assert len(links) > 60
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_top_k(vectors):
    frame, rows = vectors
    whole = {i: np.floor(64 * np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in whole:
        if q % 20 == 0:
            best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:20]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in embeddings.top_k(frame, F.col("vec_id") % 20 == 0, rows=16, query_rows=3).collect()} == want
    assert embeddings.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_token_counts(documents):
    folder = tokenizer_file("byte_bpe_50k.tiktoken")
    encode = tokens.encoder(folder, PATTERN).encode_ordinary
    for block in (7, 1 << 19):
        got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in tokens.token_counts(documents, folder, PATTERN, block=block).collect()))
        assert got == sorted((r[0] if r[0] is not None else -1, len(encode(r[1] or ""))) for r in corpus())
    assert tokens.token_counts(documents.limit(0), folder, PATTERN).count() == 0


def test_pieces(documents, spark):
    model = tokenizer_file("piece_bpe_32k.model")
    out = pieces.encode(documents, model)
    assert out.columns == [*documents.columns, "pieces", "lossless"]
    one = {(r["doc_id"], r["text"]): r["pieces"] for r in out.collect()}
    two = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(documents.repartition(7), model, chunk=100).collect()}
    assert one == two and all(r["lossless"] for r in out.select("lossless").collect())
    assert one[(0, None)] == [] and one[(5, corpus()[6][1])] != one[(6, corpus()[7][1])]


def tempered(totals, power):
    whole = sum(v**power for v in totals.values())
    return {k: v**power / whole for k, v in totals.items()}


def test_mixing(documents, spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.lit(40)).alias("text"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 == 1, F.lit(None)).otherwise("large").alias("source"), F.lit("en").alias("lang"))
    got = mixing.mix(rows, {"source": F.col("source")}, F.octet_length("text") / 4, {"source": 0.5}, keep=0.4)
    share = {r["source"]: r["n"] for r in got.where("mix_kept").groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()}
    total = sum(share.values())
    goal = tempered({"small": 0.1, None: 0.1, "large": 0.8}, 0.5)
    assert abs(total / (4000 * 50) - 0.4) < 0.03 and all(abs(share[k] / total - goal[k]) < 0.04 for k in goal)
    mixed = mixing.corpus_mix(documents)
    assert mixed.count() == len(corpus()) and mixed.where("mix_probability is null").count() == 0
    assert mixing.corpus_mix(documents.limit(0)).count() == 0


def test_mixing_meets_targets_in_production(spark):
    text = F.concat(F.repeat(F.lit("word "), (F.col("id") % 7 * 10 + 5).cast("int")), F.when(F.col("id") % 11 == 0, "a@b").when(F.col("id") % 13 == 0, "!! ").otherwise(""))
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "third").otherwise(F.concat(F.lit("s"), F.col("id") % 17)).alias("source"), F.when(F.col("id") % 19 == 0, "es").otherwise("en").alias("lang"))
    got = mixing.corpus_mix(rows).persist()
    assert 0.1 < got.agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")) / F.sum("mix_tokens")).first()[0] <= 0.8
    for name, power in (("source", 0.5), ("lang", 0.7), ("topic", 0.7)):
        sums = got.groupBy(f"mix_{name}").agg(F.sum("mix_tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability")), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens")).otherwise(0))).collect()
        goal = tempered({r[0]: r[1] for r in sums}, power)
        expected, drawn = (sum(r[k] for r in sums) for k in (2, 3))
        assert all(abs(r[2] / expected - goal[r[0]]) < 1e-6 and abs(r[3] / drawn - goal[r[0]]) < 0.04 for r in sums)
    got.unpersist()


def test_mixing_is_raking(spark):
    """Probabilities against raking in plain loops; columns named like helpers stay."""
    dice = random.Random(9)
    rows = [(k, dice.choice("aaabbc"), dice.choice(["x", "y", None]), "w" * dice.randrange(4, 400), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "doc_id int, source string, lang string, text string, rate int").withColumns({c: F.col("rate") for c in ("cell_0", "draw", "row", "factor_0", "mix_source", "mix_kept")})
    powers = {"source": 0.5, "lang": 0.7}
    out = mixing.mix(frame, {"source": F.col("source"), "lang": F.col("lang")}, F.length("text"), powers, keep=0.3)
    assert out.columns == ["doc_id", "source", "lang", "text", "rate", "cell_0", "draw", "row", "factor_0", "mix_tokens", "mix_probability", "mix_kept", "mix_source", "mix_lang"]
    got = out.collect()
    held: dict = {}
    for _, source, lang, text, _ in rows:
        held[source, lang] = held.get((source, lang), 0) + len(text)
    weight, whole = dict(held), sum(held.values())
    for _ in range(60):
        for d, power in enumerate(powers.values()):
            totals = {v: sum(n for c, n in held.items() if c[d] == v) ** power for v in {c[d] for c in held}}
            for v, t in totals.items():
                now = sum(w for c, w in weight.items() if c[d] == v)
                for c in weight:
                    if c[d] == v:
                        weight[c] *= t / sum(totals.values()) * whole / now
    ratio = {c: weight[c] / held[c] for c in held}
    factor = min(0.3, 1 / max(ratio.values()))
    assert len(got) == 500 and all(abs(r["mix_probability"] - factor * ratio[r["source"], r["lang"]]) < 1e-6 and r["rate"] == r["row"] == r["doc_id"] and r["mix_source"] == r["source"] for r in got)
    assert 0 < sum(r["mix_kept"] for r in got) < 500


def test_mixing_beyond_the_driver(spark, monkeypatch):
    dice = random.Random(2)
    rows = [(k, dice.choice("aaab"), dice.choice(["x", None])) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id int, source string, lang string")
    rates = lambda: {r["doc_id"]: r["mix_probability"] for r in mixing.mix(frame, {"source": F.col("source"), "lang": F.col("lang")}, F.lit(3), {"source": 0.5, "lang": 0.5}).collect()}
    here = rates()
    monkeypatch.setattr(mixing, "SENT_VALUES", 0)
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    joined = rates()
    assert len(joined) == 200 and all(abs(joined[k] - here[k]) < 1e-6 for k in here)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)


def test_raked_cells_need_no_python_workers(spark):
    """Cells of any kind of value come back from the driver as they were, without Python in the executors."""
    cells = spark.sql("select * from values (named_struct('x', 1), timestamp '1890-01-01 00:00:01', double('nan'), 5L), (named_struct('x', 2), null, 0.5D, 7L), (null, null, 2D, 11L), (named_struct('x', 1), null, 0.5D, 3L) as t(cell_0, cell_1, cell_2, cell_tokens)")
    cells = cells.localCheckpoint()
    here = mixing.raked_here(cells, ["cell_0", "cell_1", "cell_2"], [0.5, 0.7, 0.7])
    assert here.drop("factor_0", "factor_1", "factor_2").schema == cells.schema and sorted(map(str, here.select(cells.columns).collect())) == sorted(map(str, cells.collect()))
    assert "Python" not in here._jdf.queryExecution().toRdd().toDebugString()


def test_lattices_go_with_the_task(spark):
    """Workers live on for other operators' tasks, without the lattices of this one."""
    model = tokenizer_file("piece_bpe_32k.model")
    docs = spark.range(400).repartition(4).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), k -> conv(xxhash64(id, k), 10, 36))) as text")
    assert pieces.encode(docs, model).where("lossless").count() == 400

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            known = pieces.sampler.cache_info().currsize
            size = len(pieces.sampler(model, 1.0).ends) if known else 0
            yield pa.RecordBatch.from_arrays([pa.array([known]), pa.array([size])], names=["known", "size"])

    rows = spark.range(64).repartition(4).mapInArrow(held, "known long, size long").collect()
    assert any(r["known"] for r in rows) and not any(r["size"] for r in rows)
