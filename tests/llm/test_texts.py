import collections
import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import components, langid, linededup, mixing, packing, probminhash, quality, toxicity, vector_dedup
from brindle.llm.common import held_out, stored
from brindle.llm.words import cut_words

from .conftest import OTHER, WORDS, frame, prose


# -- language

def test_cut_words():
    cut = cut_words(["Ab c1d", None, "", "  ", "É_x"])
    assert [[cut.words[i] for i in cut.places[a:b]] for a, b in zip(cut.bounds[:-1], cut.bounds[1:])] == [["ab", "c", "d"], [], [], [], ["é", "x"]]


def test_langid(spark, rng, odd, empty):
    rows = [(i, prose(rng, 30, WORDS if i % 2 else OTHER), "one" if i % 2 else "two", "s") for i in range(200)]
    rows += [(300, "kaROx unseenlosu mitavexx", None, None), (301, None, "one", None), (302, "12 !!", "one", None)]
    got = {r.doc_id: r for r in langid.predicted(frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == ("one" if i % 2 else "two") and 0 <= got[i].score <= 1 for i in range(200))
    assert got[300].lang_pred == "one" and (got[301].lang_pred, got[302].lang_pred) == ("und", "und")
    assert langid.predicted(odd).count() == odd.count()
    assert langid.predicted(empty).count() == 0


def test_langid_of_texts_without_spaces(spark):
    r = random.Random(17)
    run = lambda words, n: "".join(r.choice(words) for _ in range(n))
    rows = [(i, run(WORDS if i % 2 else OTHER, 60), "one" if i % 2 else "two", "s") for i in range(120)]
    rows += [(300, run(OTHER, 50) + run(WORDS, 3000), None, None), (301, run(WORDS, 50) + run(OTHER, 3000), None, None)]
    got = {r.doc_id: r.lang_pred for r in langid.predicted(frame(spark, rows)).collect()}
    assert all(got[i] == ("one" if i % 2 else "two") for i in range(120))
    assert (got[300], got[301]) == ("one", "two")


def test_langid_scores_against_definition(spark):
    """Word by word from counts of its own; no table is cut."""
    r = random.Random(19)
    rows = [(i, prose(r, r.randint(1, 12), WORDS if i % 2 else OTHER), "one" if i % 2 else "two", "s") for i in range(60)]
    model = langid.fit(frame(spark, rows), F.lit(True), None, None, None, 1)
    words, grams = {k: collections.Counter() for k in ("one", "two")}, {k: collections.Counter() for k in ("one", "two")}
    for _, text, lang, _ in rows:
        for w in text.lower().split():
            words[lang][w] += 1
            grams[lang].update(f"\x02{w}\x03"[i : i + n] for n in range(1, 6) for i in range(len(w) + 3 - n))

    def logs(tables, items):
        return {x: [math.log((t[x] + 0.5) / (sum(t[y] for y in items) + 0.5 * len(items))) for t in tables.values()] for x in items}

    by_word = logs(words, set().union(*words.values()))
    by_gram = {n: logs(grams, {g for g in set().union(*grams.values()) if len(g) == n}) for n in range(1, 6)}

    def score(w):
        if w in by_word:
            return by_word[w]
        held, found = f"\x02{w}\x03", []
        for i in range(len(held)):
            for n in range(min(5, len(held) - i), 0, -1):
                if held[i : i + n] in by_gram[n]:
                    found.append([x * 0.4 ** (5 - n) for x in by_gram[n][held[i : i + n]]])
                    break
        return [sum(c) / len(found) for c in zip(*found)] if found else [0.0, 0.0]

    texts = [prose(r, 6, WORDS + OTHER + ["karozu", "quasu", "blorix", "zzz", "kalogrifen" * 3]) for _ in range(40)]
    for text, (lang, chance) in zip(texts, model.predict(texts)):
        total = [sum(c) for c in zip(*(score(w) for w in text.split()))]
        weight = [math.exp((x - max(total)) * min(1.0, 20 / len(text.split()))) for x in total]
        assert lang == ("one" if total[0] >= total[1] else "two") and math.isclose(chance, max(weight) / sum(weight), rel_tol=1e-9)


def test_langid_of_rows_without_ids(spark):
    rows = [(None, "".join(chr(97 + int(d)) for d in str(1000 + i)), "one", "s") for i in range(400)]  # a word of its own in each
    docs = frame(spark, rows)
    assert len(langid.fit(docs, F.lit(True), None, None, None, 1).words) == 400
    assert 10 < len(langid.fit(docs, F.lit(True), 40, None, None, 1).words) < 90


# -- lines

def brute_lines(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark, odd, empty):
    rng = random.Random(11)
    common = [prose(rng, 9) + x for x in ("", "É", " \x0b", "Ä")] + ["short"]
    rows = []
    for i in range(60):
        lines = [rng.choice(common + [prose(rng, 10)]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else "\t" + x if rng.random() < 0.2 else x for x in lines)))
    rows += [(61, None), (62, ""), (None, common[0]), (3, rows[3][1])]
    docs = frame(spark, [(i, t, "en", None) for i, t in rows])
    got = sorted((tuple(r) for r in linededup.digest(docs).collect()), key=str)
    assert got == brute_lines(rows)
    assert sorted((tuple(r) for r in linededup.digest(odd).collect()), key=str) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert linededup.digest(empty).count() == 0
    assert set(docs.columns) <= set(linededup.drop_repeated_lines(docs).columns)


def test_runs_tell_first_seen(spark):
    store = linededup.LineRuns(spark, buckets=2)
    batches = [[(1, 1, 10), (2, 2, 10), (2, 2, 10)], [(2, 2, 20), (3, 3, 20)], [(1, 1, 30), (3, 3, 5), (4, 4, 30)]]
    fresh = [sorted(r.a for r in store.add(spark.createDataFrame(b, "a long, b long, doc_id long")).collect()) for b in batches]
    assert fresh == [[1, 2], [3], [4]]
    assert [len(level) for level in store.levels] == [1, 1]  # two runs were merged into one of the next level
    assert sorted(r.a for run in store.runs() for r in run.collect()) == [1, 2, 3, 4]  # no two runs share a line
    assert sorted(tuple(r) for r in store.lines().collect()) == [(1, 1, 2, 30), (2, 2, 2, 20), (3, 3, 2, 20), (4, 4, 1, 30)]
    store.close()


def test_the_anti_join_decides(spark, monkeypatch):
    """Without it runs share lines, and counts are wrong."""
    monkeypatch.setattr(linededup.LineRuns, "first_seen", lambda self, batch: batch)
    line = "a line of more than forty characters, found in six documents"
    docs = frame(spark, [(i, line, "en", None) for i in range(6)])
    assert sum(r.n_dropped for r in linededup.digest(docs).collect()) != 5
    monkeypatch.undo()
    assert sum(r.n_dropped for r in linededup.digest(docs).collect()) == 5


def test_line_hashes_have_two_independent_halves(spark):
    key = "a line of more than forty characters, by whose hash it is known"
    got = spark.range(1).select(linededup.long_line_hash(F.lit(key), 40).alias("h"), F.xxhash64(F.xxhash64(F.lit(key)), F.lit(1)).alias("of_a"), F.xxhash64(F.lit(key), F.lit(1)).alias("chained")).first()
    assert got.h.a != got.h.b and got.h.b not in (got.of_a, got.chained)


def test_many_lines_dropped_from_one_document(spark):
    rng = random.Random(23)
    lines = [f"{i} " + prose(rng, 12) for i in range(3000)]
    rows = [(d, "\n".join(x for i, x in enumerate(lines) if (i + d) % 7)) for d in range(8)] + [(3, "\n".join(lines[:50])), (9, lines[0])]
    docs = frame(spark, [(i, t, "en", None) for i, t in rows])
    assert sorted((tuple(r) for r in linededup.digest(docs).collect()), key=str) == brute_lines(rows)


# -- mixing

def test_targets_stop_at_three_times():
    got = mixing.targets_of({"a": 10, "b": 100, "c": 100}, {"a": 5.0, "b": 2.0, "c": 1.0})
    assert got == {"a": 30.0, "b": 120.0, "c": 60.0}
    assert mixing.cyclic_weights(["b", None, "a", "é"]) == {"a": 5.0, "b": 2.0, "é": 1.0, None: 5.0}


def test_flow_spreads_before_it_repeats():
    flows = mixing.cheapest_flow([(frozenset("a"), 10), (frozenset("ab"), 10), (frozenset("b"), 10)], {"a": 25, "b": 5})
    taken = [sum(f.values()) for f in flows]
    assert sum(f.get("a", 0) for f in flows) == 25 and sum(f.get("b", 0) for f in flows) == 5
    assert taken == [10 + 5, 10, 5] or taken == [15, 10, 5] or (max(taken) <= 15 and sum(taken) == 30)


def cheapest_by_single_paths(patterns, quotas, most_uses):
    """Amount and cost of a cheapest largest flow, one shortest path after another."""
    names = list(quotas)
    arcs = []  # from, to, room, cost; the reverse stands next
    def arc(u, v, r, c):
        arcs.extend([[u, v, r, c], [v, u, 0, -c]])
    for i, (members, size) in enumerate(patterns):
        for use in range(most_uses):
            arc("S", i, size, use)
        for s in members:
            arc(i, f"n{s}", most_uses * size, 0)
    for s in names:
        arc(f"n{s}", "T", quotas[s], 0)
    amount = cost = 0
    while True:
        far, came = {"S": 0}, {}
        for _ in range(len(patterns) + len(names) + 2):
            for i, (u, v, r, c) in enumerate(arcs):
                if r and u in far and far[u] + c < far.get(v, 1e18):
                    far[v], came[v] = far[u] + c, i
        if "T" not in far:
            return amount, cost
        way, v = [], "T"
        while v != "S":
            way.append(came[v])
            v = arcs[came[v]][0]
        most = min(arcs[i][2] for i in way)
        for i in way:
            arcs[i][2] -= most
            arcs[i ^ 1][2] += most
        amount, cost = amount + most, cost + most * far["T"]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_a_cheapest_largest_one(seed):
    rng = random.Random(seed)
    names = "abcd"[: rng.randint(1, 4)]
    patterns = [(frozenset(rng.sample(names, rng.randint(0, len(names)))), rng.randint(0, 30)) for _ in range(rng.randint(1, 8))]
    quotas = {s: rng.randint(0, 80) for s in names}
    flows = mixing.cheapest_flow(patterns, quotas, 3)
    taken = [sum(f.values()) for f in flows]
    assert all(set(f) == set(m) and min([0, *f.values()]) == 0 and t <= 3 * size for f, t, (m, size) in zip(flows, taken, patterns))
    assert all(sum(f.get(s, 0) for f in flows) <= quotas[s] for s in names)
    cost = sum(sum(max(0, min(size, t - use * size)) * use for use in range(3)) for t, (_, size) in zip(taken, patterns))
    assert (sum(taken), cost) == cheapest_by_single_paths(patterns, quotas, 3)


def test_flow_of_many_patterns():
    rng = random.Random(3)
    names = [f"s{i}" for i in range(40)]
    patterns = [(frozenset(rng.sample(names, rng.randint(1, 5))), rng.randint(1, 1000)) for _ in range(20_000)]
    began = time.perf_counter()
    flows = mixing.cheapest_flow(patterns, {s: rng.randint(1, 1_000_000) for s in names})
    assert len(flows) == len(patterns) and time.perf_counter() - began < 60


@pytest.mark.parametrize("sorted_at_once", [100_000, 3])
def test_refined_histograms_give_the_same_mix(spark, monkeypatch, sorted_at_once):
    monkeypatch.setattr(mixing, "SORTED", sorted_at_once)
    monkeypatch.setattr(mixing, "CELL_BITS", 2 if sorted_at_once == 3 else 12)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice("ab")) for i in range(300)]
    sizes = {i: len(t.split()) for i, t, *_ in rows}
    got = {r.doc_id: r for r in mixing.digest(frame(spark, rows)).collect()}
    for s in "ab":
        own = [i for i, _, _, x in rows if x == s]
        gap = got[own[0]].target - sum(got[i].taken for i in own)
        passes = min(got[i].taken // sizes[i] for i in own)
        assert -1 <= gap and all(sizes[i] > gap for i in own if got[i].taken // sizes[i] == passes and passes < 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_comes_near_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    docs = frame(spark, rows)
    got = mixing.digest(docs).collect()
    again = mixing.digest(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    total = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size
        total[source[r.doc_id]] += r.taken
    targets = {source[r.doc_id]: r.target for r in got}
    assert abs(sum(targets.values()) - sum(size.values())) < 1e-6
    assert all(abs(total[s] - t) <= 5 for s, t in targets.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_passes_over_a_very_long_document(spark, seed):
    rng = random.Random(seed)
    sizes = {i: rng.randint(30, 70) for i in range(600)} | {1000: 12_000, 1001: 12_000}
    rows = [(i, "w " * n, ["b" if i % 2 else "a"]) for i, n in sizes.items()] + [(None, "w " * 40, ["a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    taken, names = mixing.mix(docs, F.col("tags"), weights=lambda names: {"a": 1.0, "b": 3.0}, seed=seed)
    rows, targets = taken.collect(), {r.source: r.target for r in names.collect()}
    for s in "ab":
        own = [r for r in rows if r.pattern == [s]]
        gap = targets[s] - sum(r.taken for r in own)
        passes = min(r.uses for r in own)
        assert -1 <= gap < 70 and all(r.size > gap for r in own if r.uses == passes and passes < 3)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x", "y"] if i % 2 else ["x"]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    taken, names = mixing.mix(docs, F.col("tags"), weights=lambda names: dict.fromkeys(names, 1.0))
    assert taken.agg(F.sum("taken")).first()[0] > 0 and {r.source for r in names.collect()} == {"x", "y"}


def test_mix_of_odd_documents(odd, empty):
    got = mixing.digest(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.digest(empty).count() == 0


# -- classifiers

def test_quality(spark, rng, odd, empty):
    rows = [(i, prose(rng, 60) + "." if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.predicted(docs, labels).collect()}
    assert sum(got[i].predicted == int(i % 3 > 0) for i in got) >= 297 and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.score >= 0.5}
    assert quality.predicted(odd, labels).count() == odd.count()
    assert quality.predicted(empty, labels).count() == 0
    assert {r.score for r in quality.predicted(odd, labels.where("false")).collect()} == {0.5}


def test_quality_votes_against_definition():
    r = random.Random(21)
    made = quality.Features()
    texts = [prose(r, r.randint(1, 80), WORDS if i % 2 else OTHER) + ("." if i % 2 else "!! 12") for i in range(80)]
    rows = [made.of(t) for t in texts]
    labels = np.array([i % 2 for i in range(80)])
    model = quality.LatentVotes([list(x) for x in rows], [list(x.values()) for x in rows], labels)

    def latent(row):
        x = np.zeros(quality.FEATURES)
        for c, v in row.items():
            x[c] = v
        x = x * model.idf @ model.projection
        return x / np.linalg.norm(x)

    points = [latent(x) for x in rows]
    asked = [made.of(t) for t in (prose(r, 30), prose(r, 30, OTHER) + "!!", "", None)]
    got = model.votes(asked)
    assert got[2] == got[3] == 0.5  # like none of the labelled
    for row, got in zip(asked[:2], got):
        near = sorted(((float(latent(row) @ p), y) for p, y in zip(points, labels)), reverse=True)[: quality.NEIGHBOURS]
        vote = [max(c, 1e-3) ** quality.SHARPNESS for c, _ in near]  # both classes are of one size
        assert abs(got - sum(v * y for v, (_, y) in zip(vote, near)) / sum(vote)) < 1e-3


def test_quality_features_read_words_and_their_order():
    made = quality.Features()
    a, b = made.of("Ab cd 12 EF, gh"), made.of("gh 12 Ab cd EF,")
    assert a != b and made.of("some words here") != made.of("other terms here")
    long = "a" * 5000 + "9Z" * 3000
    assert quality.shape(long) == "a" + "9A" * 3000 and made.of(long) != made.of("a" * 5000)


def brute_segments(x):
    """All maximal scoring segments of scores by their definition's recursion: the best one, then both sides."""

    def best(a, b):
        top = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += x[j]
                if top is None or t > top[0] + 1e-12:
                    top = (t, i, j)
        if top is None or top[0] <= 0:
            return []
        return best(a, top[1]) + [(top[1], top[2], top[0])] + best(top[2] + 1, b)

    return best(0, len(x))


@pytest.mark.parametrize("seed", range(20))
def test_segments_against_definition(seed):
    rng = random.Random(seed)
    x = [rng.choice([-0.5, -0.5, rng.uniform(-3, 0), rng.uniform(0.1, 3)]) for _ in range(rng.randint(0, 40))]
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = [i for i, v in enumerate(x) if v > 0]
    got = toxicity.maximal_segments(at, total[at].tolist(), total[[i + 1 for i in at]].tolist())
    want = brute_segments(x)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


@pytest.mark.parametrize("seed", range(5))
def test_toxic_scores_against_definition(seed):
    rng = random.Random(seed)
    model = toxicity.SegmentModel({"bad": 2.1013, "worse": 2.4171, "fine": -1.5377, "^grob": 1.9079}, rate=1.7, log_k=-2.0, slope=1.3, base=-2.2)
    words = ["bad", "worse", "fine", "grobian", "grob", "other", "Bad"]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 7)] + ["filler"] * 6) for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["", None]
    for text, score in zip(texts, model.score(texts)):
        x = []
        for w in (text or "").lower().split():
            known = next((v for k, v in model.scores.items() if k == w), None)
            x.append((known if known is not None else 1.9079 if w.startswith("grob") and len(w) > 4 else 0.0) - toxicity.TOLL)
        evidence = [1.7 * s - math.log(max(1, len(x))) + 2.0 for *_, s in brute_segments(x)]
        total = sum(e for e in evidence if e > -math.log(toxicity.EXPECTED))
        want = 1 / (1 + math.exp(2.2 - 1.3 * math.log1p(total)))
        assert math.isclose(score, want if total else min(want, 0.25), rel_tol=1e-9)


def test_log_odds_against_definition(spark):
    counts = [(30.0, 2.0), (1.0, 40.0), (5.0, 5.0), (0.0, 9.0)]
    t_all, c_all = 36.0, 56.0
    odds, z = toxicity.log_odds(F.col("t"), F.col("c"), t_all, c_all)
    for (t, c), r in zip(counts, spark.createDataFrame(counts, "t double, c double").select(odds.alias("o"), z.alias("z")).collect()):
        own, prior = 0.1 * (t + c), 0.1 * (t_all + c_all)
        want = math.log((t + own) / (t_all + prior - t - own)) - math.log((c + own) / (c_all + prior - c - own))
        assert math.isclose(r.o, want) and math.isclose(r.z, want / math.sqrt(1 / (t + own) + 1 / (c + own)))


def test_extreme_value_law_is_found_again():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 2000, 4000).astype(float)
    rate, log_k = 1.4, math.log(0.01)
    tops = (np.log(n) + log_k - np.log(-np.log(rng.uniform(size=4000)))) / rate  # by the law; below nothing: no segment
    got = toxicity.extreme_value_fit(n, np.maximum(tops, 0), 1.0)
    assert abs(got[0] - rate) < 0.1 and abs(got[1] - log_k) < 0.15
    assert toxicity.extreme_value_fit(n, np.zeros(4000), 1.0)[0] == 1.0


def test_neighbours_that_differ(spark):
    """A word of one fixed passage counts once, one that stands in many places counts nearly in full, on either side or at texts' ends."""
    r = random.Random(4)
    passage = "kax losu middleword nero varo"
    rows = [(1, f"start{i} {prose(r, 5)} {passage} {prose(r, 5)} end{i}") for i in range(40)]
    batches = toxicity._count(iter([__import__("pyarrow").record_batch([[y for y, _ in rows], [t for _, t in rows]], ["y", "text"])]))
    found = {x["word"]: x for b in batches for x in b.to_pylist()}
    frame = spark.createDataFrame([(w, x["toxic"], x["lefts"], x["rights"]) for w, x in found.items()], "w string, toxic long, l long, r long")
    got = {r.w: r.n for r in frame.select("w", toxicity.differing(F.col("toxic"), F.col("l"), F.col("r")).alias("n")).collect()}
    assert got["middleword"] < 2 and got["start"] > 20 and got["end"] > 20


def test_toxicity(spark, rng, odd, empty):
    bad = ["grobian", "grobling", "vexator"]
    rows = []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(900, "kax grobianus losu", None, None), (901, None, None, None), (902, "", None, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predicted(frame(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[901].predicted == got[902].predicted == 0 and got[901].score <= 0.25
    loose = spark.createDataFrame([(i, 1, int(i % 4 == 0 or i % 2)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predicted(frame(spark, rows), loose).collect()}  # most toxic labels without evidence
    assert got[901].predicted == got[902].predicted == 0
    assert toxicity.predicted(odd, labels).count() == odd.count()
    assert toxicity.predicted(empty, labels).count() == 0
    assert {r.score for r in toxicity.predicted(odd, labels.where("toxic = 0")).collect()} == {0.0}


# -- near duplicates

def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    est, want = [], []
    for _ in range(40):
        u = rng.integers(0, 2**63, 260).astype(np.uint64)
        wa, wb = rng.uniform(0.5, 3, 200), rng.uniform(0.5, 3, 200)
        a, b = u[:200], u[60:]
        s = probminhash.signatures([a, b], [wa, wb])
        est.append((s[0] == s[1]).mean())
        x = dict(zip(a.tolist(), wa.tolist()))
        y = dict(zip(b.tolist(), wb.tolist()))
        keys = set(x) | set(y)
        want.append(sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys()))
    assert abs(np.mean(est) - np.mean(want)) < 0.02


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 50, 1000)]
    weights = [np.ones(len(s)) for s in sets]
    together = probminhash.signatures(sets, weights)
    for s, w, row in zip(sets, weights, together):
        assert (probminhash.signatures([s], [w])[0] == row).all()


def brute_components(rows):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts.setdefault(i, t)
    sets = {i: set(probminhash.shingles(t.lower().split()).tolist()) for i, t in texts.items()}
    name = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (not sets[a] and not sets[b]) or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


def test_near_duplicates_against_brute_force(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(probminhash, "CHUNK", 4)
    monkeypatch.setattr(probminhash, "BLOCK", 4)
    rng = random.Random(13)
    rows = []
    for g in range(12):
        base = prose(rng, 150).split()
        for c in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    got = {r.doc_id: r for r in probminhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    want = brute_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    found = probminhash.near_duplicates(odd).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == brute_components([(r.doc_id, r.text) for r in odd.collect()]) | {1: 1}
    assert probminhash.near_duplicates(empty).count() == 0


def test_near_copies_that_repeat_a_passage(spark):
    rng = random.Random(31)
    rows = []
    for g in range(40):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        half = " ".join(base[:150])
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([half] * 60 + base[150:]))]
        for _ in range(3):  # others in their buckets, not copies
            other = list(base)
            for i in rng.sample(range(300), 14):
                other[i] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    got = {r.doc_id: r.component_id for r in probminhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def test_counts_of_cells_leave_no_link_out():
    rng = np.random.default_rng(9)
    for size in (1, 20, 300, 5000):
        u = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
        for shared in range(0, size + 1, max(1, size // 50)):
            a, b = u[:size], u[size - shared : 2 * size - shared]
            one, other = (np.frombuffer(probminhash.cells_of(x), "<u2").astype(np.int64) for x in (a, b))
            may = probminhash.may_link(one, other[None], 0.8)[0]
            assert may or shared < 0.8 * (2 * size - shared)
            assert not may or shared or size == 1 or size > 20 * probminhash.CELLS


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (30, 30)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 26)}


def brute_vectors(rows, threshold=0.93):
    good = {i: (lab, np.array(v, float)) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    name, n = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}
    links = []
    for a in good:
        for b in good:
            (la, x), (lb, y) = good[a], good[b]
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[a] += 1
                links.append((a, b))
    for _ in range(len(rows)):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    return {i: (n[i], name[i]) for i in name}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PER_LIST", 20)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "QUERIES", 8)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])], int(g % 3)))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("inf")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [1.0, 2.0], 0), (n + 5, [2.0, 4.0], 0), (n + 6, [None] * 16, 0), (n + 7, [], 0)]
    e = spark.createDataFrame(rows + [rows[0]], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(e).collect()}
    want = brute_vectors(rows)
    assert set(got) == set(want)
    links = sum(w[0] for w in want.values())
    assert sum(r.n_links for r in got.values()) >= 0.99 * links and all(got[i].n_links <= want[i][0] for i in want)
    assert sum((got[i].component_id == want[i][1]) for i in want) >= 0.99 * len(want)
    assert vector_dedup.near_duplicates(e.where("false")).count() == 0


# -- all of it

def test_vectors_with_text_labels_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.01], "a"), (2, [1.0, 0.0], "b"), (3, [1.0, 0.0], "b"), (4, [0.0, 1.0], "a")]
    e = spark.createDataFrame([(*r, 7, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, label string, n_links int, rep string, v double")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(e).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4)}


def test_vectors_of_few_dimensions_among_many(spark, monkeypatch):
    """Partners that differ in a subspace only, on many lists, several of them on a shelf or in parts."""
    monkeypatch.setattr(vector_dedup, "PER_LIST", 30)
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(700):
        x = np.zeros(64)
        x[:4] = rng.normal(size=4)
        y = x / np.linalg.norm(x)
        rows.append((len(rows), [float(np.float32(c)) for c in y], len(rows) % 2))
    want = brute_vectors(rows)
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block, shelf in ((2048, 1024), (8, 40)):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        monkeypatch.setattr(vector_dedup, "SHELF", shelf, raising=False)
        assert {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(e).collect()} == want


def test_pipeline_stages_by_their_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(29)
    line = "one line of more than forty characters that many documents share"
    rows = []
    for i in range(150):
        text = prose(rng, 60) + "." if i % 5 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        rows.append((i, f"{text}\n{line}" if i % 3 == 0 else text, "en", rng.choice(["a", "a", "b", None])))
    rows += [(200, rows[1][1] + " more", "en", "a"), (201, rows[2][1], "en", "b"), (201, rows[2][1] + " still", "en", "b"), (201, rows[3][1], "en", "a"), (None, rows[4][1], "en", "a"), (None, rows[6][1], "en", "b")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")

    def rows_of(df):
        return sorted(map(tuple, df.collect()), key=str)

    good = stored(stages["quality_classifier"](spark, docs, str(tmp_path)), "good")
    bad = {r.doc_id for r in quality.predicted(docs, labels).collect() if not r.predicted}
    assert bad == {i for i in range(0, 150, 5)} and rows_of(good) == sorted((tuple(r) for r in docs.collect() if r.doc_id not in bad), key=str)

    lines = stored(stages["line_dedup"](spark, good, str(tmp_path)), "lines")
    held = [r for r in good.collect()]
    last = max(r.doc_id for r in held if r.doc_id is not None and line in r.text)
    want = []
    for r in held:
        text = r.text if r.doc_id is None or r.doc_id == last else "\n".join(x for x in r.text.split("\n") if x != line)
        want.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows_of(lines) == sorted(want, key=str) and len(want) > 100

    alone = stored(stages["minhash_near_dedup"](spark, lines, str(tmp_path)), "alone")
    least: dict = {}
    for r in want:
        if r[0] is not None:
            least[r[0]] = min(least.get(r[0], r), r, key=lambda x: x[1])
    name = brute_components([(i, r[1]) for i, r in least.items()])
    assert rows_of(alone) == sorted([r for i, r in least.items() if name[i] == i] + [r for r in want if r[0] is None], key=str)
    assert name[200] == 1 and len(least) - sum(name[i] == i for i in least) >= 2

    mixed = stored(stages["source_mixing"](spark, alone, str(tmp_path)), "mixed")
    uses = {(r.doc_id, r.size): r.taken // r.size for r in mixing.digest(alone).collect()}
    assert rows_of(mixed) == sorted((tuple(r) for r in alone.collect() for _ in range(uses[r.doc_id, len(r.text.split())])), key=str)

    pieces = stages["retrieval_packing"](spark, mixed, str(tmp_path)).collect()
    encoded = packing.encoder(packing.default_path())
    ids = collections.Counter()
    for r, x in zip(mixed.collect(), encoded.encode_documents([r.text for r in mixed.collect()])):
        ids[r.doc_id] += len(x)
    found = collections.Counter()
    for p in pieces:
        found[p.doc_id] += p.length
    assert found == ids

    spark.createDataFrame(docs.collect(), docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert collections.Counter((p.doc_id, p.length) for p in corpus_pipeline.run(spark, str(tmp_path)).collect()).keys() == collections.Counter((p.doc_id, p.length) for p in pieces).keys()


def test_pipeline_on_odd_documents(spark, odd, empty, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == names
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
