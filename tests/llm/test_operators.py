"""Corpus operators against brute force on small fixtures, and the defined results of odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import classifier, decontaminate, html_text, jaccard_join, line_dedup, mixing, ngram_lm, pii, sketch, toxicity
from tidewater.llm._text import grams, words
from tidewater.llm.components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def random_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "ñandú", "the"]
    return ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 4))) for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "null id"), (7, "long " * 30000)]


# ---- text helpers


def test_words_are_split_and_hashed_by_content():
    texts = ["Hello  wörld\x0bfoo", None, "", "foo hello", " x", "x ", "wörld"]
    seen = {}
    for a, _, h, first in words(pa.array(texts)):
        for k in range(len(first) - 1):
            own = h[first[k] : first[k + 1]].tolist()
            want = tokens(texts[a + k])
            assert len(own) == len(want)
            for x, w in zip(own, want, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_rows_do_not_run_together():
    found = [np.diff(first).tolist() for _, _, _, first in words(pa.array(["ab", "cd", "e f"]))]
    assert found == [[1, 1, 2]]
    assert len(grams(np.arange(3, dtype=np.uint64), 5)) == 0


# ---- 1


def brute_tiles(doc, item, least):
    """Greedy tiling by looking at every pair of positions."""
    d_free, i_free, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i_free[i + n] and d_free[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        covered += n
        d_free[d : d + n] = [False] * n
        i_free[i : i + n] = [False] * n


@pytest.mark.parametrize("seed", range(60))
def test_tiles_match_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randint(1, 6) for _ in range(rng.randint(4, 24))]
    doc = [rng.randint(1, 6) for _ in range(10)] + item[len(item) // 2 :] + [9] + item[: len(item) // 2]
    tiles = decontaminate.greedy_tiles(doc, item, 3)
    assert all(doc[d : d + n] == item[i : i + n] and n >= 3 for d, i, n in tiles)
    assert len({k for d, _, n in tiles for k in range(d, d + n)}) == sum(n for *_, n in tiles)
    assert sum(n for *_, n in tiles) == brute_tiles(doc, item, 3)


def test_tiles_of_repeated_tokens():
    for size, least in ((1000, 4), (20_000, 4)):
        start = time.perf_counter()
        assert decontaminate.greedy_tiles([7] * size, [7] * 1000, least) == [(0, 0, 1000)]
        a = [7] * 300 + [8] + [7] * 699
        tiles = decontaminate.greedy_tiles([7] * size, a, least)
        assert sum(n for *_, n in tiles) == 999 - (size < 1000)
        assert time.perf_counter() - start < 1
    docs, items = ["a " * 200_000, "a b " * 3000], [(1, "a " * 1000), (2, "b a " * 500)]
    seeds = decontaminate.Seeds(items, 4, 0.6)
    got = {(a + row, item, n) for a, _, h, first in decontaminate.words(pa.array(docs), words_only=True) for row, item, n, _ in seeds.matches(h, first)}
    assert got == {(0, 1, 1000), (1, 2, 1000)}


@pytest.mark.parametrize("seed", range(20))
def test_seeded_pairs_match_tiling_of_all_pairs(seed):
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(9)]
    items = [(k, " ".join(rng.choices(some, k=rng.randint(0, 14)))) for k in range(40)]
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(25)] + [items[3][1], items[5][1] + " x " + items[6][1], ""]
    seeds = decontaminate.Seeds(items, 4, 0.6)
    got = {}
    for a, _, h, first in decontaminate.words(pa.array(texts), words_only=True):
        got |= {(a + row, item): (n, size) for row, item, n, size in seeds.matches(h, first)}
    want = {}
    for r, text in enumerate(texts):
        for i, item in items:
            x, y = text.split(), item.split()
            number = {w: k for k, w in enumerate({*x, *y})}
            n = brute_tiles([number[w] for w in x], [number[w] for w in y], min(4, len(y))) if y else 0
            if y and n >= 0.6 * len(y):
                want[r, i] = (n, len(y))
    assert got == want


def test_leaks_in_any_order(spark):
    item = [f"q{k}" for k in range(20)]
    mixed = item[10:15] + ["x"] + item[:10] + ["y"] + item[15:]
    docs = make(spark, [(1, "before " + " ".join(mixed) + " after"), (2, " ".join(item[:8]) + " none of the others"), (3, "clean text"), (4, None), (5, ""), (6, "Tiny")])
    bench = make(spark, [(10, " ".join(item).upper()), (11, None), (12, ""), (13, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 10): 1.0, (6, 13): 1.0}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.drop_leaks(docs, bench.limit(0)).count() == 6


# ---- 2

PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><a href="/">Site</a></header><nav><ul><li>Menu one</li></ul></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Head &amp; line</h1><p>First   part of the <b>story</b>,<br>next line.</p><aside>See also</aside><div class="ad-box ads">Buy now</div><p>Second part &lt;here&gt; &eacute;.</p>{close}
<section id="comments"><p>Great post by a reader of this page who likes to write a lot of words</p></section><form>Name <input name="x"></form><footer>&copy; me</footer></body></html>"""
MAIN = "Head & line\nFirst part of the story,\nnext line.\nSecond part <here> é."


def test_extraction(spark):
    pages = [(k, "u", PAGE.format(open="<article>", close="</article>")) for k in range(8)] + [(20, "u", PAGE.format(open='<div class="post">', close="</div>")), (21, "u", None), (22, "u", ""), (23, "u", "<p></p>"), (24, "u", "just words <p>and")]
    df = make(spark, pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_text(df, html_text.fit_weights(df)).collect()}
    assert got[0].text == MAIN and got[0].n_chars == len(MAIN) and got[20].text == MAIN
    assert [got[k].text for k in (21, 22, 23)] == ["", "", ""] and "words" in got[24].text
    assert html_text.fit_weights(df.limit(0))[""] == 1.0


@pytest.mark.parametrize("name", ["layout has-sidebar", "content-with-sidebar", "post no-sidebar", "entry share-enabled", "side-by-side", "page sidebar"])
def test_class_names_around_an_article(name):
    body = "<p>" + "story of many words " * 20 + "</p>"
    page = f'<html><body><div class="{name}">{body}</div><div class="ads">Buy now</div></body></html>'
    assert html_text.main_text(page, html_text.weigh({})) == ("story of many words " * 20).strip()


@pytest.mark.parametrize("open_, rest", [("<p class=byline>", "<p>"), ("<ul><li class=share>", "<li>"), ("<table><tr><td class=share>", "<td>"), ("<dl><dd class=share>", "<dt>"), ("<ul><li class=share>", "</ul><p>"), ("<p class=byline>", "<div>")])
def test_elements_without_end_tags(open_, rest):
    page = f"<html><body>{open_}By me{rest}{'text that stays ' * 20}{rest}more of it</body></html>"
    got = " ".join(t for tag, t in html_text.tokens(page) if tag is None)
    assert "By me" not in got and got.count("text that stays") == 20 and "more of it" in got


@pytest.mark.parametrize(
    "article,want",
    [
        ('<p>First real words here.</p><p class="notice">x<p>Real text goes on with many words.', "First real words here.\nReal text goes on with many words."),
        ('<ul><li class="share">Share it<li>first item<li>second item</ul><p>Tail text of the article.', "first item\nsecond item\nTail text of the article."),
        ('<section class="legal disclaimer"><p>This is the article about disclaimers.</p></section>', "This is the article about disclaimers."),
        ("<p>Some intro text.</p><table><tr><td>c1</td><td>c2</td></tr></table>", "Some intro text.\nc1\nc2"),
        ("<h2>Head</h2><figure><img src=a><figcaption>Caption</figcaption></figure><p>Body text.</p><dl><dt>a</dt><dd>b</dd></dl>", "Head\nCaption\nBody text.\na\nb"),
    ],
)
def test_whole_articles(article, want):
    plain = "<html><body><nav>Menu one</nav><article><h1>A title</h1><p>some words of text and more</p></article><footer>foot</footer></body></html>"
    weights = html_text.weigh(html_text.count_tags(plain * 3))
    for start, end in (("<article>", "</article>"), ("<div id=main>", "</div>")):
        assert html_text.main_text(f"<html><body><nav><a href=x>Menu</a></nav>{start}{article}{end}<footer>foot</footer></body></html>", weights) == want


@pytest.mark.parametrize("seed", range(20))
def test_best_run_matches_brute_force(seed):
    s = [random.Random(seed * 100 + k).randint(-5, 5) for k in range(15)]
    a, b = html_text.best_run(s)
    assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(15) for j in range(i + 1, 16)])


# ---- 3 and 5


def prose(rng, bad=False):
    w = ["".join(rng.choices("aeinrst", k=rng.randint(2, 7))) for _ in range(30)]
    return " | ".join(w) if bad else " ".join(w)


def test_quality_held_out(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, k % 4 == 0)) for k in range(400)]
    docs = make(spark, [*rows, (1000, None), (1001, "")])
    labels = make(spark, [(k, int(k % 4 != 0)) for k in range(200)], "doc_id long, quality int")
    model = classifier.fit_quality(docs, labels)
    got = {r.doc_id: r for r in classifier.score_quality(docs, model).collect()}
    assert np.mean([got[k].predicted == int(k % 4 != 0) for k in range(200, 400)]) > 0.97
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    one = classifier.fit_quality(docs, labels.filter("quality = 1"))
    assert classifier.score_quality(docs, one).agg(F.min("score")).first()[0] > 0.99
    assert classifier.score_quality(docs, classifier.fit_quality(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0.5


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    texts = [prose(rng) + (" you IDIOT!" if k % 5 == 0 else "") for k in range(500)]
    docs = make(spark, [*enumerate(texts), (1000, None), (1001, "")])
    labels = make(spark, [(k, int(k % 5 == 0)) for k in range(250)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.col("doc_id") < 250)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    wrong = [k for k in range(250, 500) if got[k].predicted != int(k % 5 == 0)]
    assert len(wrong) <= 5 and not got[1000].predicted and got[1000].score == got[1001].score
    none = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"), F.col("doc_id") < 250)
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6


def test_nnpu_risk_gradient_separates():
    rows, cols = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1])
    w, b = toxicity.train_nnpu(rows, cols, np.array([True, True, False, False]), 2, 0.3)
    assert w[0] + b > 0 > w[1] + b


def test_toxicity_blocks_cover_all_documents(spark, monkeypatch):
    """Features are counted over all training documents, and every block of them has a part in the model."""
    docs = make(spark, [(k, "meadow river cloud stone " + ("vileword " if k % 5 == 0 else f"plain{k % 7} ") * 3) for k in range(400)], "doc_id long, text string")
    labels = make(spark, [(k, int(k % 5 == 0)) for k in range(0, 400, 2)], "doc_id long, toxic int")
    whole = toxicity.fit_toxicity(docs, labels, F.col("doc_id") < 300)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 60)
    split = toxicity.fit_toxicity(docs, labels, F.col("doc_id") < 300)
    again = toxicity.fit_toxicity(docs.repartition(7), labels, F.col("doc_id") < 300)
    assert whole.ids.tolist() == split.ids.tolist() and (split.weights == again.weights).all() and split.bias == again.bias
    for model in (whole, split):
        got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
        assert all(got[k] == int(k % 5 == 0) for k in range(300, 400))
    assert toxicity.fit_toxicity(docs.limit(0), labels, F.lit(True)).bias == -50.0


# ---- 4


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for n, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append((-(1 << 63) if doc is None else doc, n))
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        d = -(1 << 63) if doc is None else doc
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(h[0] for h in holders[key(x)]) == d]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line number {k} that is long enough" for k in range(12)] + ["short", "", "  Padded line that is LONG enough \t"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for k in range(60)] + ODD
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(make(spark, rows)).collect())
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 50, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        p, slots = line_dedup.PerfectHash.build(keys)
        assert sorted(slots.tolist()) == list(range(len(keys))) and p.slots(keys).tolist() == slots.tolist()


def test_clashing_names(spark):
    df = make(spark, [(1, "a", 5, 6, 7.0)], "doc_id long, text string, n_lines long, taken long, score double").withColumn("source", F.lit("s"))
    assert line_dedup.dedup_lines(df).first().n_lines == 1
    assert mixing.mix_sources(df).first().taken == 1
    assert classifier.score_quality(df, classifier.QualityModel(np.zeros(1 << classifier.BUCKET_BITS, np.float32), 0.0)).first().score == 0.5


# ---- 6


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_against_an_explicit_automaton(spark, order, monkeypatch):
    texts = [t + "\nalpha beta gamma delta" * (k % 2) for k, t in enumerate(random_texts(80, 6))]
    texts += texts[:10]
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 2000)
    docs = make(spark, [*enumerate(texts), (1000, None)])
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    train = [t for k, t in enumerate(texts) if not held(k)] + ([] if held(1000) else [None])
    counts = [Counter() for _ in range(order)]
    for t in train:
        seq = [*tokens(t), "</s>"]
        for n in range(1, order + 1):
            counts[n - 1].update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
    total, distinct = sum(counts[0].values()), len(counts[0])
    pairs = [tuple(seq[i : i + 2]) for t in train for seq in [[*tokens(t), "</s>"]] for i in range(len(seq) - 1)]
    p0 = lambda w: (counts[0][w,] + 0.5) / (total + 0.5 * (distinct + 1))
    left_out = {b: sum(math.log10((counts[1][g] - 1 + b * p0(g[1])) / (counts[0][g[:1]] - 1 + b)) for g in pairs) for b in ngram_lm.CONCENTRATIONS}
    b = max(left_out, key=left_out.get) if order > 2 else 64.0
    states = {(), *(g for c in counts[:-1] for g in c)}

    def weight(state, w):
        """Weight of the arc of w from a state, None if it has none."""
        if not state:
            return (counts[0][w,] + 0.5) / (total + 0.5 * (distinct + 1))
        if (n := counts[len(state)][(*state, w)]) == 0:
            return None
        return (n + b * walk(state[1:], w)) / (counts[len(state) - 1][state] + b)

    def walk(state, w):
        """Probability of w along arcs and failure arcs from a state."""
        p = 1.0
        while (arc := weight(state, w)) is None:
            p *= b / (counts[len(state) - 1][state] + b)
            state = state[1:]
            while state not in states:
                state = state[1:]
        return p * arc

    # a state's probabilities, with one unseen word, sum to one
    for state in random.Random(1).sample(sorted(states), 12):
        if "</s>" not in state:
            assert sum(walk(state, w) for (w,) in counts[0]) + walk(state, "unseen") == pytest.approx(1)
    got = {r.doc_id: r for r in ngram_lm.score_lm(docs, ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1), order).collect()}
    assert len(got) == len(texts) + 1
    for k, t in [*enumerate(texts), (1000, None)]:
        score, state = 0.0, ()
        for w in (seq := [*tokens(t), "</s>"]):
            score += math.log10(walk(state, w))
            state = (*state, w)[1 - order :]
            while state not in states:
                state = state[1:]
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(counts[0][w,] > 0 for w in seq), total)
        assert r.base_score == pytest.approx(sum(math.log10(weight((), w)) for w in seq))
        assert r.score == pytest.approx(score)


def test_all_ngrams_are_states_at_any_size(spark):
    # two million tokens around three documents
    rows = [(k, "x " * 20000) for k in range(100)] + [(1000 + k, "alpha beta gamma") for k in range(2)] + [(2000, "alpha gamma beta"), (None, "alpha beta gamma")]
    got = {r.doc_id: r for r in ngram_lm.score_lm(make(spark, rows), F.col("doc_id") < 5000).collect()}
    assert got[1000].train_tokens == 2000112 and got[1000].base_score == pytest.approx(got[2000].base_score)
    assert got[None].score == got[1000].score > got[2000].score + 0.1


def test_lm_of_nothing(spark):
    assert ngram_lm.score_lm(make(spark, []), F.lit(True)).count() == 0
    got = ngram_lm.score_lm(make(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(r.score == r.base_score == 0 for r in got)  # log10(0.5 / 0.5) each


def test_counts_are_packed():
    counts = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert ngram_lm.unpack(ngram_lm.pack(counts), len(counts)).tolist() == counts.tolist()


# ---- 7


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = tokens(t)
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    parent[top(a)] = top(b)
    names = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            names[top(k)] = min(names.get(top(k), doc), doc)
    return Counter((doc, len(sets[k]), names.get(top(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 60)
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(25):
        base = [f"v{rng.randint(0, 300)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(a, t if t is None or len(t) < 1000 else "long " * 300) for a, t in ODD]
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(make(spark, rows)).collect())
    assert got == brute_components(rows)


def test_bound_of_groups_of_several_sizes(spark):
    """A group is opened wherever one of its sizes alone would be; one size is bounded by what two prefixes leave."""
    top = 26
    sizes = make(spark, [(k,) for k in range(1, top + 1)], "s long")
    n, n0, n1 = (sizes.select(F.col("s").alias(x)) for x in ("n", "n0", "n1"))
    rows = n.crossJoin(n0).crossJoin(n1).filter("n0 <= n1").withColumn("c", F.explode(F.expr("sequence(1L, least(n, n1))")))
    got = {(r.c, r.n, r.n0, r.n1): r.may for r in rows.withColumn("may", jaccard_join.may_link(F.col("c"), F.col("n"), F.col("n0"), F.col("n1"), 75)).collect()}
    rest = lambda size: -(-75 * size // 100) - 1
    one = lambda c, n, m: 75 * max(n, m) <= 100 * min(n, m) and 175 * (c + max(rest(n), rest(m))) >= 75 * (n + m)
    assert got[1, 10, 11, 12] and len(got) > 10000
    for (c, n, n0, n1), may in got.items():
        want = any(one(c, n, m) for m in range(n0, n1 + 1))
        assert may or not want, (c, n, n0, n1)
        assert n0 < n1 or may == want, (c, n, n0, n1)


def test_links_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """A family in which nearly all pairs link gives one link for each copy, not one for each pair."""
    rng, rows = random.Random(3), {}
    base = [f"w{k}" for k in range(100)]
    opened = jaccard_join.open_groups
    for n in (150, 300):
        texts = []
        for _ in range(n):
            text = list(base)
            text[rng.randrange(100)] = f"x{rng.random()}"
            texts.append(" ".join(text))
        found = []
        monkeypatch.setattr(jaccard_join, "open_groups", lambda *a, found=found, **k: (found.append(opened(*a, **k)), found[-1])[1])
        monkeypatch.setattr(jaccard_join, "free", lambda *t: None)
        assert {r.component_id for r in jaccard_join.jaccard_components(make(spark, [*enumerate(texts)])).collect()} == {0}
        rows[n] = sum(f.count() for f in found)
    assert rows[150] < 300 and rows[300] < 600


def test_spanning_links_match_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        sets = [np.unique(np.array([rng.randrange(12) for _ in range(rng.randint(1, 9))], np.uint64)) for _ in range(14)]
        asks = np.array([rng.random() < 0.5 for _ in sets])
        node, root = np.arange(14), np.array([rng.randrange(14) for _ in sets])
        links = jaccard_join.spanning_links(sets, node, root, asks, 60)
        near = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
        label = list(root)
        for a in np.flatnonzero(asks):
            for b in np.flatnonzero(~asks):
                if near(a, b):
                    label = [label[a] if x == label[b] else x for x in label]
        got = list(root)
        for a, b in links:
            assert asks[a] and not asks[b] and near(a, b) and got[a] != got[b]
            got = [got[a] if x == got[b] else x for x in got]
        assert [[x == y for x in got] for y in got] == [[x == y for x in label] for y in label]


def test_jaccard_of_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u"
    rows = [(None, a), (None, b), (None, "x y z x y"), (5, a), (5, "q w e r t"), (5, None), (None, None)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(make(spark, rows)).collect())
    assert got == Counter([(None, 16, 5), (None, 16, 5), (None, 1, None), (5, 16, 5), (5, 1, 5), (5, 0, 5), (None, 0, None)])


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(make(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.jaccard_components(make(spark, [(3, "a b c")])).collect()] == [(3, 1, 3)]


def test_components_of_a_chain(spark):
    links = make(spark, [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.u: r.v for r in connected_components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


# ---- 8


def test_sketches_recover_differences():
    rng = np.random.default_rng(8)
    sides = []
    for n, m in ((0, 0), (5, 0), (50, 50), (400, 30)):
        common = rng.integers(0, 1 << 62, n).astype(np.uint64)
        own = rng.integers(0, 1 << 62, 2 * m).astype(np.uint64)
        sides.append((np.concatenate([common, own[:m]]), np.concatenate([common, own[m:]])))
    digest = np.concatenate([x for pair in sides for x in pair])
    first = np.cumsum([0, *[len(x) for pair in sides for x in pair]])
    a, b = np.arange(0, 8, 2), np.arange(1, 8, 2)
    found = {k: (set(), set()) for k in range(4)}
    done = []
    for finished, pair, d, sign in sketch.differences(a, b, digest, first):
        done += finished.tolist()
        for p, x, s in zip(pair.tolist(), d.tolist(), sign.tolist(), strict=True):
            found[p][s < 0].add(x)
    assert sorted(done) == [0, 1, 2, 3]
    for k, (x, y) in enumerate(sides):
        assert found[k] == (set(x.tolist()) - set(y.tolist()), set(y.tolist()) - set(x.tolist()))


def test_fingerprints_match_brute_force(spark):
    texts = random_texts(60, 9)
    texts[10] = texts[11]
    rows = [*enumerate(texts), (100, None), (None, "x y")]
    got = {r.doc_id: r for r in sketch.fingerprint_versions(make(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))

    def digests(t):
        d, _ = sketch.paragraphs(*sketch.utf8(pa.array([t])))
        return set(d.tolist())

    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(digests(text), digests(changed))) and r.near_next == pytest.approx(like(digests(text), digests(following)))
    assert got[10].fingerprint == got[11].fingerprint and got[100].n_chars == 0
    assert sketch.fingerprint_versions(make(spark, [])).count() == 0
    alone = sketch.fingerprint_versions(make(spark, [(1, "a b c d e f")])).first()
    assert alone.near_next == 1.0


# ---- 9

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, r in enumerate(BASE):
        for m in re.finditer(r, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(10)
    parts = ["a@b.c", "@", ".", "x", "1", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "256.1.1.1", "a.b@c", "é", " ", "-", "0000000000000000", "@d.e.f"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(11)
    number = lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(k, f"Filler words here. Please call me at {number()} about the {rng.randint(10**9, 10**10 - 1)} parts") for k in range(20)]
    rows += [(100, "you should call me at (555) 123-4567 today"), (101, "about the 5551234567 parts"), (102, None), (103, "")]
    docs = make(spark, rows)
    found = pii.learn_patterns(docs.select("text"))
    got = {r.doc_id: r for r in pii.find_pii(docs, found).collect()}
    text = rows[20][1]
    a = text.index("(555)")
    assert got[100].spans == f"phone:{a}:{a + 14}" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == "" and got[103].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[k].n_phone == 1 for k in range(20))
    assert pii.learn_patterns(docs.select("text").limit(0)) == {}


def test_frequent_words_do_not_push_out_rare_patterns(spark):
    rng = random.Random(13)
    number = lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(k, f"the end of the day , the {number()}") for k in range(30)] + [(100 + k, f"Dial {number()} now") for k in range(4)] + [(200, "Dial (555) 123-4567 now")]
    docs = make(spark, rows)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs, pii.learn_patterns(docs.select("text"))).collect()}
    assert got[200] == "phone:5:19"


def test_copies_do_not_spoil_a_pattern(spark):
    rng = random.Random(15)
    number = lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(k, f"Dial {number()} now") for k in range(6)] + [(100 + k, "Dial +1 (555) 123-4567 now") for k in range(40)] + [(200, "Dial (555) 123-4567 now")]
    # copies of a text without an identifier count against a pattern, as before
    rows += [(300 + k, f"call {number()}") for k in range(6)] + [(400 + k, "call me") for k in range(40)] + [(500, "call (555) 123-4567")]
    docs = make(spark, rows)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs, pii.learn_patterns(docs.select("text"))).collect()}
    assert got[200] == "phone:5:19" and got[500] == ""


def test_context_counts_match_brute_force(spark, monkeypatch):
    texts = random_texts(40, 14)
    pairs = Counter()
    for t in texts:
        w = tokens(t)
        pairs.update((x,) for x in w)
        pairs.update(zip(w[:-1], w[1:], strict=True))
    key = lambda g: pii._pattern_keys(" ".join(g) + " 5", [(len(" ".join(g)) + 1, len(" ".join(g)) + 2)])[0][0]
    picked = sorted(pairs)[::3]
    right = next(g for g in picked if len(g) == 1)
    after = pii._pattern_keys("5 " + right[0], [(0, 1)])[0][0]
    monkeypatch.setattr(pii, "FILTER_BITS", 4)
    patterns = make(spark, [(key(g),) for g in picked] + [(12345,), (after,)], "pattern long")
    got = {r.pattern: r.n for r in pii.context_counts(make(spark, [*enumerate([*texts, None])]).select("text"), patterns).collect()}
    assert got == {key(g): pairs[g] for g in picked} | {after: pairs[right]}


def test_pattern_keys_match_the_words_around():
    rng = random.Random(16)
    for _ in range(200):
        left, right = ([rng.choice(["foo", "Bär", "x,", "é"]) for _ in range(rng.randint(0, 3))] for _ in range(2))
        glued, tail = rng.choice(["", "tel:"]), rng.choice(["", ",", ")ö"])
        text = " ".join([*left, glued + "555-1234" + tail, *right])
        a = text.index("555")
        got = pii._pattern_keys(text, [(a, a + 8)])[0]
        h = lambda *w: next(words(pa.array([" ".join(w)])))[2]
        before, after = [*left, *filter(None, [glued])], [*filter(None, [tail]), *right]
        want = [grams(h(*before[-k:]), k)[0] for k in (2, 1) if len(before) >= k]
        if after:
            want.append(pii._rightward(grams(h(after[0]), 1))[0])
        assert got[:-1] == np.array(want, np.uint64).view(np.int64).tolist()
        assert got[-1] == pii._pattern_keys("444-9876", [(0, 8)])[0][-1]


def test_long_runs_take_linear_time():
    for run in ("1" * 200000, "1." * 100000, "a." * 100000, "1 " * 100000, "+1" * 100000, "a(at)" * 40000, "@a" * 100000, "1-" * 100000, "." * 200000):
        began = time.process_time()
        pii.likely_spans(run, base := pii.base_spans(run))
        assert time.process_time() - began < 3, (run[:5], len(base))


def test_new_instances_bring_new_patterns(spark):
    """Cards that fail the check digit follow words of good ones; the word that follows those finds further ones."""
    rng = random.Random(17)

    def card(valid):
        while True:
            digits = "4" + "".join(rng.choices("0123456789", k=15))
            if pii.luhn(digits) == valid:
                return digits

    rows = [(k, f"pay by {card(True)} today") for k in range(30)]
    rows += [(100 + k, f"pay by {card(False)} cvv given") for k in range(6)] + [(200 + k, f"some other {card(False)} cvv given") for k in range(6)]
    rows += [(300 + k, f"parcel {rng.randint(10**11, 10**12)} left") for k in range(30)]
    got = {r.doc_id: r.spans for r in pii.find_pii(make(spark, rows), pii.learn_patterns(make(spark, rows).select("text"))).collect()}
    hit = {k for k, spans in got.items() if spans}
    planted = {k for k, _ in rows if k < 300}
    assert len(hit & planted) >= 0.9 * len(planted) and len(hit & planted) >= 0.9 * len(hit)
    assert got[200] == "card:11:27" and not any(got[k] for k in got if k >= 300)


def test_decoys_stay_unmarked_without_context(spark):
    """Numbers that look like cards but fail the check digit, among random words and beside words of real ones."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    plain = lambda n: " ".join(rng.choices(vocabulary, k=n))

    def card(valid):
        while True:
            digits = "".join(rng.choices("0123456789", k=16))
            if pii.luhn(digits) == valid:
                return digits

    rows = [(k, f"{plain(3)} {card(True)} {plain(3)}") for k in range(60)]  # the shape alone goes with many seeds
    rows += [(100 + k, f"{plain(3)} {card(False)} {plain(3)}") for k in range(60)]
    rows += [(200 + k, f"{plain(2)} card no {card(True)} {plain(2)}") for k in range(30)]
    rows += [(300 + k, f"{plain(2)} card no {card(False)} {plain(2)}") for k in range(15)]
    docs = make(spark, rows)
    got = {r.doc_id: (r.n_card, r.spans) for r in pii.find_pii(docs, pii.learn_patterns(docs.select("text"))).collect()}
    assert all(got[k][0] == 1 for k in (*range(60), *range(200, 230)))
    marked = {k for k, (n, spans) in got.items() if not n and spans}
    planted = set(range(300, 315))
    assert len(marked & planted) >= 0.9 * len(planted) and len(marked & planted) >= 0.9 * len(marked)


def naive_patterns(texts, rounds=3):
    edges, n = Counter(), Counter()
    for text in texts:
        w = text.split(" ")
        for k in range(len(w)):
            n["1", w[k].lower()] += 1
            n["r", w[k].lower()] += 1
            n["2", " ".join(w[max(0, k - 1) : k + 1]).lower()] += k > 0
        base = pii.base_spans(text)
        for a, kind, b in [*base, *((a, -1, b) for a, b in pii.likely_spans(text, base))]:
            left, right = text[:a].split(), text[b:].split()
            own = [("2", " ".join(left[-2:]).lower())] * (len(left) > 1) + [("1", left[-1].lower())] * bool(left) + [("r", right[0].lower())] * bool(right)
            own.append(("s", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", text[a:b]))))
            edges.update((p, text[a:b].lower(), kind) for p in own)
    for p in {p for p, _, _ in edges}:
        links = sum(c for (q, _, _), c in edges.items() if q == p)
        n[p] = links if p[0] == "s" else max(n[p], links)
    seeds = {(v, k): 1.0 for _, v, k in edges if k >= 0}
    accepted = dict(seeds)
    for _ in range(rounds):
        scores = {}
        for p in {p for p, _, _ in edges}:
            for of in range(4):
                mine = [(v, c * accepted[v, of]) for (q, v, k), c in edges.items() if q == p and k in (-1, of) and (v, of) in accepted]
                if len({v for v, _ in mine}) >= 3:
                    scores[p] = max(scores.get(p, (-1, 0, 0)), (sum(c for _, c in mine) / n[p], len({v for v, _ in mine}), -of))
        accepted = dict(seeds)
        for v in {v for _, v, k in edges if k < 0}:
            for of in range(4):
                own = [min(scores[p][0], 0.999999) for (p, x, k) in edges if x == v and k < 0 and p[0] != "s" and p in scores and -scores[p][2] == of]
                if own and 1 - math.prod(1 - x for x in own) >= 0.5:
                    accepted[v, of] = 1.0
    return {p: -s[2] for p, s in scores.items() if s[0] >= 0.5}


def test_patterns_match_a_naive_graph(spark):
    rng = random.Random(18)
    number = lambda: rng.choice([f"+1 {rng.randint(200, 999)} {rng.randint(100, 999)}-{rng.randint(1000, 9999)}", f"555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", f"10.{rng.randint(0, 300)}.1.{rng.randint(0, 9)}", str(rng.randint(10**8, 10**9))])
    texts = [f"{rng.choice(['call me', 'host', 'the number', 'the', 'order no'])} {number()} {rng.choice(['now', 'today', 'the end'])}" for _ in range(120)] + ["the the end"] * 10
    naive = naive_patterns(texts)

    def key(p):
        if p[0] == "s":
            return pii._value("shape " + p[1])
        h = next(words(pa.array([p[1]])))[2]
        g = grams(h, len(h))
        return int((pii._rightward(g) if p[0] == "r" else g).view(np.int64)[0])

    got = pii.learn_patterns(make(spark, [*enumerate(texts)]).select("text"))
    assert got == {key(p): of for p, of in naive.items()} and len(got) > 3


# ---- 10


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(300)] + [(900, None, "z"), (901, "", "z")]
    df = make(spark, rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, dict(weights), sum(sizes.values())
    while True:  # clamp, reshare, again
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            del free[s]
    target |= {s: level * w for s, w in free.items()}
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0


# ---- all


def test_mixing_many_sources_gives_the_same(spark, monkeypatch):
    """Where sources are too many to be broadcast, the join by source and bucket gives the same rows."""
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(300)] + [(7, "w w", "b"), (900, None, "z"), (None, "x y", None)]
    df = make(spark, rows, "doc_id long, text string, source string")

    def seen():
        return Counter(tuple(r) for r in mixing.mix_sources(df, bucket_rows=20).collect())

    narrow = seen()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert seen() == narrow and sum(narrow.values()) == len(rows)


def test_every_operator_is_registered():
    from tidewater.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_ids_of_any_type(spark):
    for kind, value in (("int", 3), ("short", 3), ("string", "q"), ("date", __import__("datetime").date(2020, 1, 2))):
        bench = make(spark, [(value, "one two three four five six")], f"item_id {kind}, text string")
        got = decontaminate.find_leaks(make(spark, [(1, "zero one two three four five six")]), bench).collect()
        assert [(r.doc_id, r.item_id, r.matched) for r in got] == [(1, value, 6)]


def test_columns_of_any_name(spark):
    names = ("block", "shard", "n", "node", "keys", "hi", "kind", "size", "k")
    rows = make(spark, [(k, "the same line of text here\nown line", *range(9)) for k in range(4)], "doc_id long, text string, " + ", ".join(f"{x} int" for x in names))
    assert all(tuple(r[x] for x in names) == tuple(range(9)) for r in line_dedup.dedup_lines(rows).collect())
    bench = make(spark, [(1, "one two three four five")], "item_id long, text string")
    for table in (decontaminate.drop_leaks(rows, bench), decontaminate.find_leaks(rows, bench), ngram_lm.score_lm(rows, F.lit(True)), pii.find_pii(rows, {}), sketch.fingerprint_versions(rows), mixing.mix_sources(rows.withColumn("source", F.lit("a")))):
        table.collect()


def test_empty_tables(spark):
    docs, bench = make(spark, [], SCHEMA), make(spark, [], "item_id long, text string")
    some = make(spark, [(1, "one two three four five")], "item_id long, text string")
    for items in (bench, some):
        assert decontaminate.find_leaks(docs, items).count() == decontaminate.drop_leaks(docs, items).count() == 0
    pages = make(spark, [], "page_id long, url string, html string")
    assert html_text.extract_text(pages, html_text.fit_weights(pages)).count() == 0
    assert pii.find_pii(docs, pii.learn_patterns(docs.select("text"))).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0 and mixing.mix_sources(docs).count() == 0
    assert sketch.fingerprint_versions(docs).count() == 0


def test_odd_rows_in_every_operator(spark):
    docs = make(spark, [(a, t, "en", None, 0) for a, t in ODD], SCHEMA)
    bench = make(spark, [(1, "one two three four five")], "item_id long, text string")
    n = len(ODD)
    assert decontaminate.drop_leaks(docs, bench).count() == n
    assert ngram_lm.score_lm(docs, F.lit(True)).count() == n
    none = ngram_lm.score_lm(docs, F.lit(False)).collect()
    assert len(none) == n and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert sketch.fingerprint_versions(docs).count() == n
    assert pii.find_pii(docs, {}).count() == n
    assert mixing.mix_sources(docs).count() == n
