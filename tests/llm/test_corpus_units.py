"""Parts of the corpus operators against plain versions, without Spark."""

import random

import numpy as np
import pytest

from moraine.llm import common, embeddings, html, pieces, shingles, suffix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_suffix_arrays():
    dice = random.Random(1)
    for _ in range(1500):
        x = [dice.randrange(dice.choice([1, 2, 4])) for _ in range(dice.randrange(40))]
        assert suffix.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_bytes_are_compared():
    dice = np.random.default_rng(3)
    data = dice.integers(0, 3, 4000).astype(np.uint8)
    a, b = dice.integers(0, 3900, (2, 900))
    b[:300] = a[:300]
    for length in (8, 13, 50):
        want = [data[x : x + length].tobytes() == data[y : y + length].tobytes() for x, y in zip(a, b)]
        assert suffix._same_bytes(suffix._words(data), a, b, length).tolist() == want
    end = len(data) - 50
    assert suffix._same_bytes(suffix._words(data), np.array([end]), np.array([end]), 50).all()


def test_window_minima():
    dice = random.Random(4)
    core = "".join(dice.choice("abc") for _ in range(20))
    parts = ["".join(dice.choice("ab") for _ in range(30)) + core + "".join(dice.choice("ab") for _ in range(30)) for _ in range(40)]
    parts += parts[:10] + [p[:60] + "c" * 20 for p in parts[:10]]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    begin, doc = np.arange(len(parts)) * 80, np.array(dice.sample(range(1000), len(parts)))
    got = suffix.window_minima(np.zeros(len(parts), np.uint64), begin, begin + 80, data, doc, 50)
    least: dict = {}
    for p, d in zip(parts, doc):
        for k in range(31):
            least[p[k : k + 50]] = min(d, least.get(p[k : k + 50], d))
    assert got.tolist() == [least[p[k : k + 50]] for p in parts for k in range(31)]


@pytest.mark.parametrize("values", [[], [5], [1, 1, 9, 1 << 60]])
def test_squeezed_integers(values):
    x = np.array(values, np.uint64)
    assert (suffix._expand(suffix._squeeze(x, True), np.uint64, True) == x).all()
    assert (suffix._expand(suffix._squeeze(x), np.uint64) == x).all()


def test_alignment():
    dice = random.Random(2)

    def length(a, b):
        rows = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(rows[j] + 1 if x == y else max(rows[j + 1], new[j]))
            rows = new
        return rows[-1]

    for _ in range(400):
        a, b = ([dice.randrange(4) for _ in range(dice.randrange(14))] for _ in "ab")
        found = html.aligned(a, b)
        assert len(found) == length(a, b)
        rest = iter(b)
        assert all(any(y == a[k] for y in rest) for k in found)


def test_page_lines():
    page = '<head><title>t</title></head><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>t</b>wo<p>x<div class="ad-box">buy</div></article><footer>f</footer>'
    assert html.main_text(html.lines(page), set()) == "A & B one two x"
    assert html.lines(None) == [] and html.main_text([], set()) == ""
    plain = html.lines("<div>site name</div><div>a long text of this page</div>")
    assert html.main_text(plain, {0}) == "a long text of this page"
    assert html.main_text(html.lines('<main class="no-sidebar overflow-hidden"><p>own</p><div class="site-footer">f</div><div id="ad_box2">b</div></main>'), set()) == "own"
    assert html.lines("<p>1 < 2 <b") == [("1 < 2", 0)]


def test_lines_deleted_as_shared():
    assert html._parted(html.lines("<div>site</div><article>own</article>"), {0}) == (["own"], 1)
    assert html._parted(html.lines("<div>site</div><article>own</article>"), {0, 1}) == (["own"], 1)  # an article's text stays
    plain = html.lines("<div>site name</div><nav>menu</nav><div>a long text of this page</div>")
    assert html._parted(plain, {0, 1}) == (["a long text of this page"], 2)
    assert html._parted(plain, set()) == (["site name", "a long text of this page"], 0)


def test_nearness():
    dice = random.Random(8)
    for _ in range(500):
        a, b = ("".join(dice.choice("ab/") for _ in range(dice.randrange(9))) for _ in "ab")
        assert html.nearness(a, b) == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_shingle_sets():
    texts = ["", "one", "One one ONE", "a b\ta b", " \n", "x" * 5000, "é b"]
    raw = [t.encode() for t in texts]
    row, value = shingles.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
    assert np.bincount(row, minlength=len(texts)).tolist() == [0, 1, 1, 2, 0, 1, 1]
    assert len(set(value.tolist())) == len(value)


def test_segmentations_have_their_probabilities():
    tool, n = pieces.Sampler(MODEL), 20_000
    ids, bounds = tool.encode(["other"] * n, np.arange(n, dtype=np.uint64))
    seen: dict = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        seen[tuple(ids[a:b])] = seen.get(tuple(ids[a:b]), 0) + 1

    def every(word):
        if not word:
            yield (), 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in tool.plain:
                for rest, weight in every(word[k:]):
                    yield (tool.plain[word[:k]], *rest), weight + tool.weight[tool.plain[word[:k]]]

    paths = dict(every(" other"))
    whole = sum(np.exp(w) for w in paths.values())
    assert set(seen) <= set(paths)
    assert max(abs(seen.get(p, 0) / n - np.exp(w) / whole) for p, w in paths.items()) < 0.012


def test_segmentations_do_not_depend_on_what_was_read_before():
    dice = random.Random(6)
    words = ["".join(dice.choice("aeioutrnsl") for _ in range(dice.randrange(1, 14))) for _ in range(3000)]
    texts = [" ".join(dice.choice(words) for _ in range(dice.randrange(120))) for _ in range(60)] + ["a" * 9000, "é\U0001f600" * 400]
    seeds = np.arange(len(texts), dtype=np.uint64)
    one, two = pieces.Sampler(MODEL), pieces.Sampler(MODEL, bound=1)
    assert one.learn(sorted(set(words), key=lambda w: w[::-1]))
    ids, bounds = one.encode(texts, seeds)
    for order in (range(len(texts)), reversed(range(len(texts)))):
        for k in order:  # with a cache that starts anew all the time, in small slices
            own, _ = two.encode([texts[k]], seeds[k : k + 1], step=7, width=50)
            assert own.tolist() == ids[bounds[k] : bounds[k + 1]].tolist()
    held = lambda: sum(x.nbytes for x in (two.upto, two.came, two.piece, two.root, two.first))
    two.encode(texts[:3], seeds[:3])
    two.encode(texts[:1], seeds[:1])
    assert held() < 1 << 20


@pytest.mark.parametrize("text", ["", " ", "héllo ▁ wörld\n\n  x😀y\t\x00z", "a" * 3000, "日本語 テキスト", "\n"])
def test_decoding_is_lossless(text):
    tool = pieces.Sampler(MODEL, bound=1)
    for seed in range(3):
        ids, _ = tool.encode([text], np.array([seed], np.uint64))
        again, _ = tool.encode(["other words", text], np.array([9, seed], np.uint64))
        assert tool.decode(ids) == text.encode()
        assert len(ids) == 0 or again[-len(ids) :].tolist() == ids.tolist()  # a row's result is its own


def test_best_in_block():
    dice = np.random.default_rng(4)
    x = dice.integers(-30, 30, (300, 16)).astype(float)
    x[50:60] = x[40]  # ties
    ids = dice.permutation(300)
    i, j, score = embeddings.best_in_block(x[:20], ids[:20], x, ids, 7)
    coarse = embeddings.best_in_block(x[:20], ids[:20], x, ids, 7, embeddings.Index(x, levels=4))
    assert all((a == b).all() for a, b in zip(coarse, (i, j, score)))
    for q in range(20):
        s = x @ x[q]
        want = sorted((k for k in range(300) if k != q), key=lambda k: (-s[k], ids[k]))[:7]
        assert j[i == q].tolist() == want and score[i == q].tolist() == [s[k] for k in want]


def test_a_huge_component_hides_no_row():
    x = np.r_[np.full((1, 8), 1e39), np.random.default_rng(2).integers(-30, 30, (40, 8)).astype(float)]
    i, j, score = embeddings.best_in_block(x[1:6], np.arange(1, 6), x, np.arange(41), 50)
    assert len(i) == 5 * 40 and np.isfinite(score).all()


def test_index_holds_every_posting_by_descending_impact():
    x = np.random.default_rng(6).integers(-90, 90, (50, 7)).astype(float)
    index = embeddings.Index(x, levels=18)
    assert (np.diff(index.impact) <= 0).all() and index.width > 1
    n = len(index.heads)
    again = sum(index.postings(a, min(a + 3, n), x.shape) for a in range(0, n, 3))
    assert (np.abs(x - again) < index.width).all() and (x * again >= 0).all() and (np.abs(again) <= np.abs(x)).all()


def test_codes():
    dice = np.random.default_rng(5)
    for d in (24, 7, 65):
        x = dice.standard_normal((60, d))
        x = np.concatenate([x, x[:30] + 0.1 * dice.standard_normal((30, d))])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        turn = embeddings.rotation(d, 1)
        made = embeddings.Codes.of(u, turn)
        code = embeddings.Codes.read(made.blobs(), d)
        assert all(np.array_equal(getattr(made, f), getattr(code, f)) for f in ("signs", "factor", "levels", "step", "lost"))
        assert np.allclose(np.linalg.norm(u @ turn - code.rotated(), axis=1), code.lost, atol=1e-5)
        assert np.allclose(np.einsum("ij,ij->i", u @ turn, code.code()), code.factor, atol=1e-5)
        i, j = embeddings.possible_pairs(code, code, True, 0.95)
        found, want = set(zip(i.tolist(), j.tolist())), {(a, b) for a in range(90) for b in range(a + 1, 90) if u[a] @ u[b] >= 0.95}
        assert want <= found and (d < 20 or len(found) < 8 * max(len(want), 40))


def test_estimates_are_unbiased():
    dice, off = np.random.default_rng(7), []
    a, b = dice.standard_normal((2, 32))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    for seed in range(600):
        code = embeddings.Codes.of(np.stack([a, b]), embeddings.rotation.__wrapped__(32, seed))
        off.append(float(code.code()[0] @ code.rotated()[1] / code.factor[0] - a @ b))
    assert abs(np.mean(off)) < 4 * np.std(off) / 600**0.5


def test_chunks_bound_texts_too():
    """Each text of a chunk takes 16 KB of sketch counters, however short it is."""
    offsets = np.arange(5001) * 7
    found = list(shingles.chunks(offsets))
    assert [r for a, b in found for r in range(a, b)] == list(range(5000))
    assert max(b - a for a, b in found) <= 512
    assert list(shingles.chunks(np.array([0, 5, 5, 1 << 22, (1 << 22) + 1]))) == [(0, 2), (2, 3), (3, 4)]  # long texts stay whole


def test_free_memory_is_given_back():
    """Blocks that are freed below one that is still held would stay with the process."""
    pytest.importorskip("resource")
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pins = []

    def run(batches):
        held = []
        for batch in batches:
            for _ in range(2000):
                held.append(np.ones(8000, np.uint8))
                held.append(np.ones(40000, np.uint8))
                pins.append(np.ones(2000, np.uint8))
            yield batch
        held.clear()

    before, seen = resident(), []
    for _ in common.given_back(run)(iter([0])):
        seen.append(resident())
    assert seen[0] - before > 60e6 and resident() - before < 0.4 * (seen[0] - before)
