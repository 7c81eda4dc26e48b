"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import json
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from irloom.llm import ann, chat_format, decontamination, language_id, mixing, quality, sharding, simhash, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "the cat sat on the mat with a hat", "en", "a", 33), (4, "the cat sat on the mat with a hat", "en", "b", 33),
        (4, "the cat sat on the mat with a hat", "en", "b", 33), (5, long, None, "b", len(long)), (None, "null id text here", "de", "b", 17), (6, "  \t\n ", "de", "c", 5),
        (7, "12345 !!! ???", "fr", "c", 13), (8, "älter größer über straße", "de", "c", 24), (8, "another text of the same id", "en", "c", 27), (9, "\x00zero\x00 byte", "en", "", 10),
    ]
    return spark.createDataFrame(rows, DOCS)


# --- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 1000, 4097])
def test_feistel_is_a_permutation(n):
    places = [sharding.place(i, n) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert all(sharding.unplace(p, n) == i for i, p in enumerate(places))


def test_shard_law_rows_on_odd_documents(spark):
    docs = odd_docs(spark).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    out = sharding.shard(docs, 5).toPandas()
    assert len(out) == 12 and sorted(out.global_row) == list(range(12))
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    for r in out.itertuples():
        p = sharding.place(r.global_row, 12)
        assert (r.shard, r.slot) == (p % 5, p // 5)
    assert out.sort_values("global_row").doc_id.isna().iloc[0]


def test_shard_hot_ids_and_empty(spark):
    rows = [(7 if i % 3 == 0 else (None if i % 3 == 1 else i), f"t{i % 50}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, 8).select("global_row", "doc_id", "shard", "slot").toPandas()
    assert sorted(out.global_row) == list(range(6000))
    ids = out.sort_values("global_row").doc_id.fillna(-1).tolist()
    assert ids == sorted(ids)
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_shard_lots_of_equal_rows(spark):
    """Rows equal in id and text, ids and texts null or not, fill many ranges and are numbered in parts."""
    rows = [(None, None)] * 3000 + [(5, "same")] * 3000 + [(5, f"t{i}") for i in range(1500)] + [(i, f"u{i}") for i in range(1500)] + [(None, f"n{i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc")
    out = sharding.shard(docs, 8).select("global_row", "doc_id", crc, "shard", "slot").orderBy("global_row").collect()
    assert [r.global_row for r in out] == list(range(len(rows)))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.crc) for r in out]
    assert keys == sorted(keys)
    assert sharding.shard(docs.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("doc_id"), "text"), 8).count() == len(rows)


# --- mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_mix_targets_and_thresholds(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "d", None, "é"]) if i % 3 else "a") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing._sized(docs)
    sizes = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    want = brute_targets(sizes)
    out = mixing.copies(docs).withColumn("h", mixing.row_hash()).toPandas()
    out["source"] = out["source"].where(out["source"].notna(), None)
    for source, target in want.items():
        part = out[out.source.isna()] if source is None else out[out.source == source]
        assert abs(part.mix_target.iloc[0] - target) < 1e-6 * max(1, target)
        taken = (part.mix_size * part.mix_copies).sum()
        assert abs(taken - target) <= part.mix_size.max()
        assert (part.mix_copies <= 3).all()
        # a prefix of the hash order is taken once more
        order = part.sort_values("h").mix_copies.tolist()
        assert order == sorted(order, reverse=True)


def test_mix_takes_copies_one_by_one(spark):
    """Rows equal in id and text come near the target, none of them over its limit; with and without other rows."""
    same = [(7, "w " * 50, "a")] * 500
    for rows in (same + [(1000 + i, "x y z", "b") for i in range(300)], same + [(7, "w " * 50, None)] * 200, same + [(i, "w w", "a") for i in range(10, 300)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        out = mixing.copies(docs).toPandas()
        assert len(out) == len(rows)
        for _, part in out.groupby("source", dropna=False):
            taken = (part.mix_size * part.mix_copies).sum()
            assert abs(taken - part.mix_target.iloc[0]) <= part.mix_size.max() / 2 + 1e-6 and part.mix_copies.max() <= 3


def test_mix_odd_and_empty(spark):
    out = mixing.copies(odd_docs(spark).withColumn("mix_size", F.lit("x"))).toPandas()
    assert len(out) == 12 and (out.mix_copies >= 0).all() and (out.mix_copies <= 3).all()
    assert mixing.copies(odd_docs(spark).limit(0)).count() == 0


# --- url filters


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "https://A.Example.COM/en/7x?q=1", "http://x.com/en/1", "http://com/en/", "http://xcom/en/1", "ftp://b.net?de/", "http://b.example.net/de/8", "http://o.org/es/#x", "http://o.org"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = {r.page_id: r for r in url_filters.judge(pages.withColumn("rule", F.lit(0))).collect()}
    assert (out[0].host, out[0].path, out[0].rule) == ("", "", None) and out[1].host == ""
    assert (out[2].host, out[2].path, out[2].rule, out[2].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[3].rule == out[4].rule == "com/en/" and out[5].rule is None
    assert (out[6].host, out[6].path, out[6].rule) == ("b.net", "", None)
    assert out[7].rule == "example.net/de/8" and out[8].verdict == "block" and out[9].verdict == "block"  # half of o.org's pages are blocked
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_rules_are_those_of_the_contract(spark, tmp_path):
    """Each rule's word, in the code and in its SQL, is the contract's: pages on hosts of their own, so that nothing but rules counts."""
    import duckdb

    rows = [(1, "http://a.com/en/1", None), (2, "http://example.com/en/7", None), (3, "http://c.net/de/1", None), (4, "http://example.net/de/8", None), (5, "http://e.org/es/1", None), (6, "http://s.example.net/de/7", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 6: ("net/de/", "allow")}
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.op5_link_propagation(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: (r[3], r[4]) for r in con.sql(url_filters.ORACLE["op5_link_propagation"]).fetchall()} == want


def test_propagation_matches_brute_force(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.org" for i in range(12)]
    rows = []
    for i in range(80):
        src = rng.choice(hosts)
        to = "".join(f'<a href="https://{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{src}/{rng.choice(['es/1', 'a/2'])}", to))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    parts = url_filters.with_host_path(pages)
    edges = url_filters.links(parts)
    n = {(r.src, r.dst): r.n for r in edges.collect()}
    seeds = {h: (i % 4) / 4 for i, h in enumerate(hosts)}
    got = {r.host: r.score for r in url_filters.propagate(spark.createDataFrame(list(seeds.items()), "host string, s double"), edges, damping=0.4).collect()}
    score = dict(seeds)
    for _ in range(100):
        new = dict(seeds)
        for (a, b), k in n.items():
            new[b] += 0.4 * score[a] * k / sum(v for (x, _), v in n.items() if x == a)
        score = new
    assert all(abs(got[h] - score[h]) < url_filters.SETTLED * sum(seeds.values()) for h in hosts)
    assert url_filters.DAMPING**url_filters.ROUNDS < url_filters.SETTLED


def test_links_of_any_form(spark):
    html = """<a href="https://A.org/x"> <a HREF='//b.org?q'> <a href=http://c.org:80#z> <a href=\\"https://d.org\\"> <a href=\\"//e.org/\\"> <a href="/local/x.html"> <a href="#top"> href = "ftp://f.org" """
    pages = spark.createDataFrame([(1, "http://own.org/p", html), (2, "http://own.org/q", None)], "page_id long, url string, html string")
    found = {r.dst: r.n for r in url_filters.links(url_filters.with_host_path(pages)).collect()}
    assert found == {"a.org": 1, "b.org": 1, "c.org:80": 1, "d.org": 1, "e.org": 1, "f.org": 1}


def test_pages_are_judged_by_links(spark, tmp_path):
    """Hosts without rules: who links to blocked hosts is blocked, who is linked by trusted ones is not; as the SQL has it."""
    import duckdb

    rows = [(1, "http://bad.org/es/1", None), (2, "http://example.com/en/7", '<a href="//mixed.io/">')]
    rows += [(10, "http://farm.io/", '<a href="http://bad.org/es/2">'), (20, "http://farmer.io/", '<a href="//farm.io">')]
    rows += [(30, "http://mixed.io/a", '<a href="https://fine.io/">'), (40, "http://fine.io/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in url_filters.op5_link_propagation(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "allow", 10: "block", 20: "block", 30: "allow", 40: "allow"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[-1] for r in con.sql(url_filters.ORACLE["op5_link_propagation"]).fetchall()} == got


# --- simhash


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if sum(v >> i & 1 for v in h) * 2 > len(h))


def brute_components(rows, fps, bits=4):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        if r is not None:
            best[root(i)] = min(best.get(root(i), 1 << 60), r)
    return [best.get(root(i)) for i in range(len(rows))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append((" " * rng.randint(1, 3)).join(copy))
    texts += [None, "", " \n", "Solo"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    out = simhash.components(docs).select("doc_id", F.lower(F.hex("fp")).alias("fp"), "component_id").toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, fps)
    for i, f, c in zip(ids, fps, want):
        assert out.loc[i].fp == f"{f:016x}" and out.loc[i].component_id == c


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = []
    for b in base:
        flips.append(b)
        for _ in range(rng.integers(0, 4)):
            b = b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64))
            flips.append(b)
    fps = np.unique(np.array(flips, np.uint64))[:, None]
    every = simhash.Forest(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps ^ fps[:, 0][None, :]) <= 4)
    every.link(a, b)
    rule, found = simhash.EXACT, simhash.Forest(len(fps))
    for lane, mask in simhash._masks(rule):
        tree = simhash.build(fps[::2, lane], mask, 4)
        row, leaf, own = simhash.route(fps[:, lane], tree, mask, 4, rule.radius)
        assert own.sum() == len(fps)
        for k in np.unique(leaf):
            r = row[leaf == k]
            x, y = simhash.search(fps[r], own[leaf == k], lane, mask, rule)
            found.link(r[x], r[y])
    n = np.arange(len(fps))
    assert (every._roots(n) == found._roots(n)).all()


def test_spanning_forest_is_least():
    rng = np.random.default_rng(6)
    for n in (2, 5, 30, 200):
        a, b, d = rng.integers(0, n, 4 * n), rng.integers(0, n, 4 * n), rng.integers(0, 9, 4 * n)
        got = simhash.spanning(a, b, d, n)
        up, total, count = list(range(n)), 0, 0

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for w, x, y in sorted(zip(d.tolist(), a.tolist(), b.tolist())):
            if root(x) != root(y):
                up[root(x)] = root(y)
                total, count = total + w, count + 1
        assert len(got) == count and d[got].sum() == total


def near_copies(seed, groups, words=400):
    """Texts around common ones: id, text; similarities lie on both sides of 0.8."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"v{rng.randrange(words)}" for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(words)}"
            out.append((len(out), " ".join(copy)))
    return out


def brute_similar(rows, similarity=0.8, width=5):
    """Pairs of ids whose shingle sets are that similar."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = list(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if not (sets[a] or sets[b]) or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


@pytest.mark.parametrize("shard_rows", [16_384, 64])
def test_near_duplicates_match_brute_force(spark, monkeypatch, shard_rows):
    """No pair under the similarity is linked, and at least nine tenths of those over it; leaves over a shard's size are cut."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rows = [*near_copies(3, 60), (5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (None, "one  two")]
    hot = " ".join(f"h{i}" for i in range(80)).split()
    rng = random.Random(5)
    for k in range(300):  # a group of near copies that no block of bits tells apart
        copy = list(hot)
        copy[rng.randrange(80)] = f"x{k}"
        rows.append((6000 + k, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.components(frame, simhash.similar(len(rows))).collect()}
    pairs = brute_similar([r for r in rows if r[0] is not None])
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    linked = sum(out[a] == out[b] for a, b in pairs)
    assert linked >= 0.97 * len(pairs) and all(root(out[i]) == root(i) for i in up)
    assert out[5000] == out[5001] == 5000 and out[None] == out[5003] == out[5002] == 5002
    kept = [r.doc_id for r in simhash.keep_one(frame).collect()]
    assert sorted(kept) == sorted(set(out.values()))


@pytest.mark.parametrize("known", [0, 4, 1 << 17])
def test_near_duplicates_lose_no_pair(spark, monkeypatch, known):
    """Components are those of all pairs at the similarity, also of those that no block of bits finds; whatever is known of common shingles."""
    monkeypatch.setattr(simhash, "ORDER_MOST", known)
    monkeypatch.setattr(simhash, "PART", 500)
    frequent = " ".join(f"f{i}" for i in range(30))
    rows = near_copies(11, 200) + [(7000 + k, f"{frequent} " + " ".join(f"u{k // 2}x{i}" for i in range(k % 2, 8))) for k in range(120)]
    rows += [(8000, None), (8001, ""), (8002, "one two"), (8003, "a b c d e"), (8004, "A b c d e"), (8005, "a b c d e f"), (8006, "a b c d e f a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute_similar(rows):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {i: root(i) for i in up}
    assert {r.doc_id: r.component_id for r in simhash.components(frame, simhash.similar()).collect()} == want
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == sorted(set(want.values()))
    if known:  # with no help from the fingerprints at all, the rest is everything
        monkeypatch.setattr(simhash, "forests", lambda unique, rule, f=simhash.forests: f(unique, rule).limit(0))
        assert {r.doc_id: r.component_id for r in simhash.components(frame, simhash.similar()).collect()} == want


def test_parities_never_rule_out_too_much():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 63, 64, 65, 130, 1000, 5000):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        for m in (0, 1, n // 3, n):
            y = np.union1d(x[m // 2 :], rng.integers(0, 1 << 64, m, np.uint64, endpoint=False))
            apart = len(np.setxor1d(x, y))
            least = simhash._least_apart(simhash._odd(x), simhash._odd(y))
            assert least <= apart and (least > 0 or not apart or m == 0 or n < 3)


@pytest.mark.parametrize("rows", [1 << 10, 1 << 22, 1 << 30])
def test_blocks_meet_for_similar_texts(rows):
    """Of pairs just at the similarity, blocks and bits keep at least 0.95, for every width."""
    import math

    rule, p = simhash.similar(rows), math.acos(8 / 9) / math.pi
    size = [int(m).bit_count() for _, m in simhash._masks(rule)]
    assert len(size) == rule.blocks and sum(size) == 64 * rule.lanes
    missed = math.prod(1 - sum(math.comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(rule.radius + 1)) for b in size)
    far = 1 - sum(math.comb(64 * rule.lanes, k) * p**k * (1 - p) ** (64 * rule.lanes - k) for k in range(rule.bits + 1))
    assert missed < 0.025 and far < 0.03


def test_contraction_in_one_task_and_in_rounds(spark, monkeypatch):
    """Few edges are contracted in one task, many in rounds over the cluster: the stars are the same."""
    rng = random.Random(2)
    pairs = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(250)) if a != b}
    edges = spark.createDataFrame([(a.to_bytes(9, "big"), b.to_bytes(9, "big")) for a, b in pairs], "a binary, b binary").repartition(7)
    one = {(bytes(r.a), bytes(r.b)) for r in simhash._contract(edges).collect()}
    monkeypatch.setattr(simhash, "FEW", 0)
    assert one == {(bytes(r.a), bytes(r.b)) for r in simhash._contract(edges).collect()} and len(one) > 100
    monkeypatch.undo()
    assert simhash._contract(edges.limit(0)).count() == 0


def test_language_sample_reaches_the_driver_packed(spark, monkeypatch):
    """What the driver collects to fit the classifiers is a small part of the vectors."""
    docs = spark.createDataFrame([(i, f"{'ab' if i % 2 else 'cd'} w{i} " * 20, "xy"[i % 2]) for i in range(600)], "doc_id long, text string, lang string")
    frame, got = type(docs), []
    monkeypatch.setattr(frame, "toArrow", lambda self, f=frame.toArrow: got.append(f(self)) or got[-1])
    assert language_id.train(docs).labels == ["x", "y"]
    assert got[0].num_rows == 600 and got[0].nbytes < 600 * language_id.FEATURES * 2 / 4


def test_similar_rule_is_one_for_every_size():
    """What is linked doesn't change where a table grows past some number of rows."""
    assert len({simhash.similar(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, (1 << 26) + 1, 1 << 34)} | {simhash.similar()}) == 1


def test_simhash_keeps_one_of_each_group(spark):
    docs = odd_docs(spark)
    out = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in out if x is not None) == [1, 3, 5, 7, 8, 8, 9] and out.count(None) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.components(docs.limit(0)).count() == 0


# --- decontamination


def edit_distance_inside(item, text):
    """Fewest edits between the item and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    syllables = ["th", "an", "er", "ion", "re", "és", "ou", "be"]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(k, text(rng.randint(20, 50))) for k in range(12)] + [(90, "ab"), (91, None), (92, "")]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 80))
        if i % 2:
            y = list(items[i % 12][1])
            for _ in range(rng.choice([0, 1, 3, 8, 20])):
                y[rng.randrange(len(y))] = rng.choice("xyzq")
            t = f"{t} {''.join(y)} {text(10)}"
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "has Ab, inside"), (103, "cab able")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.find(frame, bench).collect()}
    norm = lambda s: decontamination.normalise(np.frombuffer((s or "").encode(), np.uint8))[0].tobytes().strip()
    want = {}
    for d, t in docs:
        for k, x in items:
            x, y = norm(x), norm(t)
            if len(x) > 8 and y:
                e = edit_distance_inside(x, y)
                if e <= int(0.05 * len(x)):
                    want[d, k] = e
    want[102, 90] = 0
    assert got == want
    clean = {r.doc_id for r in decontamination.without_passages(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.find(frame, bench.limit(0)).count() == 0
    assert decontamination.find(odd_docs(spark), bench).count() == 0


def test_passage_across_steps():
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(2_000))
    bench = decontamination.Benchmark([(k, item) for k in range(100)])
    half = item[: len(item) // 2]
    text = (half + " " + half + " " + half + " " + half)[: 41_943 - len(half)] + " " + item
    data = decontamination.normalise(np.frombuffer(text.encode(), np.uint8))[0]
    found = bench.hits(data)
    assert {h[0] for h in found} == set(range(100)) and all(h[3] == 0 for h in found)


def test_many_items_alike():
    """21,000 items of one template: a text that holds one word for word finds it, and all that are within the edits."""
    rng = random.Random(1)
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(46))
    items = [(i, f"{base} item {i:06d} {rng.randrange(10**9)}") for i in range(21_000)]
    bench = decontamination.Benchmark(items)
    data = decontamination.normalise(np.frombuffer(f"some words before {items[777][1]} and after".encode(), np.uint8))[0]
    found = {bench.ids[h[0]]: h[3] for h in bench.hits(data)}
    assert found[777] == 0 and len(found) == len(items)


def test_hot_gram_matches_brute_force():
    """One q-gram in every item and many times in the text."""
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(["common filler phrase", f"w{rng.randrange(50)}", "zz"]) for _ in range(12))) for i in range(30)]
    bench = decontamination.Benchmark(items)
    text = " ".join(["common filler phrase"] * 200 + [items[3][1]] + ["common filler phrase w1 zz"] * 50 + [items[9][1].replace("zz", "zy", 1)])
    data = decontamination.normalise(np.frombuffer(text.encode(), np.uint8))[0]
    got = {}
    for i, _, _, e in bench.hits(data):
        got[bench.ids[i]] = min(e, got.get(bench.ids[i], 99))
    want = {i: e for i, t in items if (e := edit_distance_inside(t.encode(), data.tobytes())) <= int(0.05 * len(t))}
    assert got == want and {3, 9} <= set(got)


# --- learned operators


def test_codewords_differ():
    for n in range(2, 40):
        code = simhash and language_id.codebook(n)
        assert len({tuple(r) for r in code}) == n


def test_language_id(spark):
    rng = random.Random(1)
    pools = {"en": ["the", "cat", "house", "with"], "de": ["straße", "über", "nicht", "haus"], "xx": ["qzq", "zqz", "qqz"]}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(12)), k, "s", 1) for i in range(300) for k in [list(pools)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs)
    out = language_id.predict(docs, model, ["doc_id", "lang"]).toPandas()
    assert (out.lang == out.lang_pred).all() and out.score.between(0, 1).all()
    odd = language_id.predict(odd_docs(spark).withColumn("score", F.lit("x")), model, ["doc_id", "text", "score"]).toPandas()
    assert len(odd) == 12
    for r in odd.itertuples():
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert language_id.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language_id.predict(docs, one, ["doc_id"]).collect()} == {"de"}


def test_vectors_and_decoding_match_brute_force(monkeypatch):
    texts = ["", "Älter als die straße 12", "aa", "x", "The cat sat. " * 40, "é"]
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0] + [len(r) for r in raw])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    want = np.zeros((len(raw), language_id.FEATURES))
    for i, r in enumerate(raw):
        low = [int(language_id._FOLD[c]) for c in r]
        for size in (1, 2, 3):
            for k in range(len(low) - size + 1):
                value = size << 24
                for j, c in enumerate(low[k : k + size]):
                    value |= c << (8 * (size - 1 - j))
                want[i, (value * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    want = np.sqrt(want / np.maximum(want.sum(axis=1, keepdims=True), 1))
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert np.allclose(language_id.vectors(whole, begins), want, atol=1e-6)
    rng = np.random.default_rng(1)
    code = language_id.codebook(5)
    model = language_id.Model(list("abcde"), code, rng.normal(size=(language_id.FEATURES + 1, code.shape[1])).astype(np.float32), rng.random(code.shape[1]))
    best, score, gap = language_id.decode(want.astype(np.float32), model)
    for i, x in enumerate(want):
        loss = [sum(model.trust[b] * np.log1p(np.exp(-(8 * x @ model.weight[:-1, b] + model.weight[-1, b]) * code[k, b])) for b in range(code.shape[1])) for k in range(5)]
        ordered = sorted(loss)
        assert best[i] == int(np.argmin(loss)) and abs(gap[i] - (ordered[1] - ordered[0])) < 1e-3
        assert abs(score[i] - np.exp(-ordered[0]) / np.exp(-np.array(loss)).sum()) < 1e-4


def test_language_sample_is_even_and_bounded(spark, monkeypatch):
    """Every label is learned, a common one from no more rows than its share."""
    monkeypatch.setattr(language_id, "MOST_ROWS", 60)
    rows = [(i, f"aaa bbb {i % 7}", "en", "s", 1) for i in range(2000)] + [(3000 + i, f"zzz qqq {i}", f"l{i % 3}", "s", 1) for i in range(9)]
    seen = []
    real = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, y, labels: seen.append(np.bincount(y).tolist()) or real(x, y, labels))
    model = language_id.train(spark.createDataFrame(rows, DOCS))
    assert model.labels == ["en", "l0", "l1", "l2"] and seen == [[15, 3, 3, 3]]


def test_automaton_accepts_one_edit():
    terms = ["idiot", "scum", "loser", "größe"]
    auto = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            p, kind = rng.randrange(len(w) + 1), rng.random()
            if kind < 0.4:
                w.insert(p, rng.choice("abioß"))
            elif w and kind < 0.7:
                del w[min(p, len(w) - 1)]
            elif w:
                w[min(p, len(w) - 1)] = rng.choice("abioß")
        word = "".join(w)
        near = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= toxicity.budget(t)]
        assert auto.match(word) == (min(near)[::-1] if near else None)


def test_toxicity(spark):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(600):
        t = [rng.choice(filler) for _ in range(20)]
        bad = i % 3 == 0
        if bad:
            t[rng.randrange(20)] = rng.choice(["badword", "worseword", "awfulone"])
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    assert {"badword", "worseword", "awfulone"} <= set(model.lexicon.terms)
    asks = [(1, "you badwrod... bad"), (2, "you are a B4dword indeed"), (3, 'he said "badword" to us'), (4, "nothing here"), (5, None), (6, "")]
    out = {r.doc_id: r for r in toxicity.predict(spark.createDataFrame(asks, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert out[2].predicted == 1 and out[4].predicted == out[5].predicted == out[6].predicted == 0
    assert out[3].score < out[2].score
    assert len(toxicity.predict(odd_docs(spark).withColumn("predicted", F.lit(1)), model, ["doc_id", "predicted"]).collect()) == 12
    assert toxicity.train(frame, marks.limit(0)) == 0.0 and toxicity.train(frame, marks.where("toxic = 1")) == 1.0
    assert toxicity.predict(frame.limit(0), model, ["doc_id"]).count() == 0


def test_toxic_features_match_brute_force():
    """Terms by edit distance, contexts by the letter of the rule, sums by text."""
    terms, weights = ["badword", "scum", "größe"], [3.0, 2.0, 1.0]
    matcher = toxicity.Lexicon(terms, weights).open()
    texts = ["", "you badword scum scum", 'he said "badwrod" then', "B4DWORD! and Größe", "she called him scum", "plain text", "badword " * 5]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        return new

    raw = [t.encode() for t in texts]
    begins = np.cumsum([0] + [len(r) for r in raw])
    got = matcher.features(np.frombuffer(b"".join(raw), np.uint8), begins)
    for t, row in zip(texts, got):
        whole = t.encode()
        low = toxicity.fold(np.frombuffer(whole, np.uint8), np.array([0, len(whole)])).tobytes()
        hits, at = [], 0
        for w in low.split():
            at = low.index(w, at)
            near = [(distance(w.decode(), x), k) for k, x in enumerate(terms) if distance(w.decode(), x) <= toxicity.budget(x)]
            if near:
                e, k = min(near)
                inside = whole[max(0, at - 60) : at].count(b'"') % 2 == 1 and b'"' in whole[at + len(w) : at + len(w) + 60]
                told = any(x in toxicity.REPORTING for x in low[max(0, at - 30) : at].split()[-3:])
                c = (0.3 if inside else 1.0) * (0.6 if told else 1.0)
                hits.append((k, weights[k] * (1 - 0.3 * e) * c, c))
            at += len(w)
        best = {}
        for k, v, c in hits:
            best[k] = max(best.get(k, (0, 0)), (v, c))
        plain = [v for v, c in best.values() if c >= 1]
        want = [
            np.log1p(sum(v for v, _ in best.values())), max((v for v, _ in best.values()), default=0), np.log1p(len(best)), np.log1p(sum(plain)),
            np.log1p(sum(v for _, v, _ in hits) * 1000 / max(len(whole), 200)), np.log1p(len(plain)),
        ]
        assert np.allclose(row, want)


def test_quality(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = " ".join(f"w{rng.randrange(500)}" for _ in range(200)) if good else " ".join(["spam!!"] * 150)
        docs.append((i, t))
        labels.append((i, int(good), 0))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(frame, marks)
    out = quality.predict(frame, model, ["doc_id"]).toPandas().set_index("doc_id")
    assert all(out.loc[i].predicted == y for i, y, _ in labels)
    odd = quality.predict(odd_docs(spark).withColumn("score", F.lit("x")), model, ["doc_id", "score"]).toPandas()
    assert len(odd) == 12 and odd.score.between(0, 1).all()
    assert quality.train(frame, marks.limit(0)) == 0.0
    assert quality.predict(frame.limit(0), model, ["doc_id"]).count() == 0


def test_passage_gradient():
    """The slopes that the fit descends, against finite differences of the loss."""
    rng = np.random.default_rng(0)
    x, many, y, each = rng.normal(size=(30, quality.FEATURES)), np.array([3, 7, 10, 10]), np.array([0, 1, 0, 1]), np.array([0.1, 0.2, 0.3, 0.4])
    shapes = {"w": (quality.FEATURES, 5), "b": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "d": (1,)}
    p = {k: rng.normal(0, 0.5, s) for k, s in shapes.items()}

    def loss():
        logit = quality._forward(p, x, many)[-1]
        return (each * (np.logaddexp(0, logit) - y * logit)).sum()

    slopes = quality._slopes(p, x, many, y, each)
    for k, part in p.items():
        for at in np.ndindex(part.shape):
            held, part[at] = part[at], part[at] + 1e-6
            up = loss()
            part[at] = held - 1e-6
            down = loss()
            part[at] = held
            assert abs((up - down) / 2e-6 - slopes[k][at]) < 1e-7
    model = quality.fit(x, many, y)
    assert ((quality.scores(x, many, model) >= quality.CUT) == (y == 1)).all()


def test_passages_match_brute_force():
    texts = ["", "a b a b  c", "Spam!! " * 200, "x" * 1300 + " tail", "é|ü 12\nnew line"]
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0] + [len(r) for r in raw])
    x, many = quality.passages(np.frombuffer(b"".join(raw), np.uint8), begins)
    row = 0
    for r, m in zip(raw, many):
        assert m == max(1, -(-len(r) // quality.PASSAGE))
        starts = [i for i in range(len(r)) if not r[i : i + 1].isspace() and (i == 0 or r[i - 1 : i].isspace())]
        for k in range(m):
            part = r[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
            kinds = np.bincount([quality._KIND[c] for c in part], minlength=len(quality._KINDS)) / max(1, len(part))
            assert np.allclose(x[row, : len(quality._KINDS)], np.sqrt(kinds), atol=1e-6)
            words = [r[s:].split()[0] for s in starts if s // quality.PASSAGE == k]  # a word belongs where it begins
            n = max(1, len(words))
            want = [
                sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n, len(set(words)) / n, sum(map(len, words)) / n / 10,
                sum(len(w) >= 20 for w in words) / n, sum(len(w) <= 2 for w in words) / n, np.log1p(len(part)) / 6, np.log1p(m) / 6,
            ]
            assert np.allclose(x[row, len(quality._KINDS) :], want, atol=1e-6)
            row += 1


# --- nearest neighbours


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 32), (5060, [float("nan")] * 32), (5080, [float("inf")] + [1.0] * 31), (5100, [1.0] * 31), (None, [1.0] * 32), (5120, [None] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(df.withColumn("v", F.lit(1)), lambda i: i % 20 == 0, 20).toPandas()
    x = np.concatenate((x.astype(float), np.append(np.ones(31), 0)[None]))  # a shorter vector lacks components, which are zero
    ids = np.append(np.arange(3000), 5100)
    exact = x @ x.T
    hits = total = 0
    assert set(out.query_id) == {*range(0, 3000, 20), 5100}
    for q, part in out.groupby("query_id"):
        s = dict(zip(ids.tolist(), exact[ids.tolist().index(q)]))
        del s[q]
        best = set(sorted(s, key=lambda i: (-s[i], i))[:20])
        hits, total = hits + len(best & set(part.vec_id)), total + 20
        assert list(part.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(part.score, [s[i] for i in part.vec_id])
    assert hits / total >= 0.9


def test_search_in_double_precision(spark):
    v = [[1.0, 0.0], [0.1000000002, 1.0], [0.1000000001, 1.0], [1e300, -1e300], [1e308, 1e308]]
    df = spark.createDataFrame([(i * 20, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = [(r.vec_id, r.score) for r in ann.search(df, lambda i: i == 0, 20).orderBy("rank").collect()]
    assert out == [(80, 1e308), (60, 1e300), (20, 0.1000000002), (40, 0.1000000001)]
    out = [(r.vec_id, r.score) for r in ann.search(df, lambda i: i == 80, 20).orderBy("rank").collect()]
    assert [i for i, _ in out] == [20, 40, 0, 60] and not np.isfinite(out[3][1])


def test_search_in_chunks_and_blocks(spark, monkeypatch):
    """Small chunks and blocks give the same as one of each."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "CHUNK", (64, 64, 1))
    monkeypatch.setattr(ann, "BLOCK", (16, 16, 1))
    out = ann.search(df, lambda i: i % 5 == 0, 7, rerank=64).orderBy("query_id", "rank").collect()
    exact = x @ x.T
    for q in range(0, 600, 5):
        s = exact[q].copy()
        s[q] = -np.inf
        assert [r.vec_id for r in out if r.query_id == q] == np.lexsort((np.arange(600), -s))[:7].tolist()


def test_search_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.5, 0.0, 0.0]), (2, [0.5, 0.0, 0.0]), (0, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    out = ann.search(df, lambda i: i % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0, 20).count() == 0


def test_search_many_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    x[1] = 2 * x[0]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(1000 - i, [float(a) for a in x[1]]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    for k, rerank in ((20, 4), (300, 4), (20, 200)):
        out = ann.search(df, lambda i: i % 1001 == 0, k, rerank=rerank).orderBy("rank").collect()
        ids, all_ = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
        score = all_ @ x[0].astype(float)
        want = [(int(ids[j])) for j in np.lexsort((ids, -np.round(score, 9))) if ids[j] != 0][:k]
        assert [r.vec_id for r in out] == want
    far = ann.search(df, lambda i: i == 2, 20).collect()
    score = {int(i): float(np.dot(v, x[2].astype(float))) for i, v in rows if i != 2}
    assert sorted((r.score for r in far), reverse=True) == pytest.approx(sorted(score.values(), reverse=True)[:20])


# --- chat


def test_chat_links_and_orders(spark):
    call = lambda *cs: json.dumps({"tool_calls": [dict(id=i, name=n, arguments=json.dumps(a), depends_on=d) for i, n, a, d in cs]})
    rows = [
        (1, 0, "assistant", call(("a", "respond", {"turn": 1, "text": "x"}, ["b"]), ("b", "respond", {"text": 3}, []))), (1, 1, "tool", '{"tool_call_id": "a", "content": "ok"}'),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "late"}'), (1, 3, "tool", '{"tool_call_id": "zz"}'), (2, 0, "assistant", call(("p", "nope", {}, ["q"]), ("q", "nope", {}, ["p"]))),
        (3, 0, "user", "hello"), (3, 1, "assistant", "hi"), (3, 2, "user", None), (3, 3, "system", "{not json"), (None, 0, None, ""),
    ]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(0))).collect()
    by = {(r.conv_id, r.turn, r.number, r.id): r for r in out}
    a, b = by[1, 0, 0, "a"], by[1, 0, 1, "b"]
    assert (a.level, a.status, a.result_turn, a.valid) == (1, "linked", 1, True) and a.json.startswith('{"arguments":{"text":"x","turn":1},"conv_id":1')
    assert (b.level, b.status, b.valid, b.problems) == (0, "unanswered", False, "text,turn")
    assert by[1, 3, 0, "zz"].status == "orphan" and by[2, 0, 0, "p"].status == by[2, 0, 1, "q"].status == "cycle"
    assert by[3, 0, 0, "0"].status == "linked" and by[3, 2, 0, "2"].problems == "text" and by[3, 3, 0, None].status == "alone" and by[None, 0, 0, None].status == "alone"
    assert chat_format.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_matches_brute_force(spark):
    """Random calls in JSON: links, statuses and levels against a walk over each conversation."""
    rng = random.Random(12)
    rows = []
    for conv in range(25):
        turn = 0
        names = [f"c{k}" for k in range(rng.randint(1, 7))]
        todo = names[:]
        while todo:
            some = [todo.pop(0) for _ in range(min(len(todo), rng.randint(1, 3)))]
            calls = [{"id": i, "name": "respond", "arguments": json.dumps({"text": "x", "turn": turn}), "depends_on": rng.sample(names, rng.randint(0, min(2, len(names))))} for i in some]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            turn += 1
        for i in rng.sample([*names, "zz"], rng.randint(0, len(names))):
            rows.append((conv, turn, "tool", json.dumps({"tool_call_id": i, "content": f"r{turn}"})))
            turn += 1
    rng.shuffle(rows)
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in range(25):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        calls, results = {}, {}
        for _, turn, _, text in mine:
            said = json.loads(text)
            for k, c in enumerate(said.get("tool_calls", [])):
                calls[c["id"]] = ((turn, k), c["depends_on"])
            if "tool_call_id" in said:
                results.setdefault(said["tool_call_id"], turn)
        reach = {i: {j for j in need if j in calls} for i, (_, need) in calls.items()}
        for _ in calls:
            reach = {i: r | {x for j in r for x in reach[j]} for i, r in reach.items()}

        def level(i):
            """The least level over those of later calls it needs, and not under those of earlier ones."""
            at, need = calls[i]
            return max([0] + [level(j) + (calls[j][0] >= at) for j in need if j in calls])

        # on or behind a cycle with a call that waits for a later one; every cycle has one
        stuck = {i for i in calls if i in reach[i] or any(j in reach[j] for j in reach[i])}
        for r in out:
            if r.conv_id == conv and r.kind == "call":
                assert r.level == (-1 if r.id in stuck else level(r.id))
                assert r.status == ("cycle" if r.id in stuck else "linked" if r.id in results else "unanswered") and r.result_turn == results.get(r.id)
            if r.conv_id == conv and r.kind == "result":
                assert r.status == ("linked" if r.id in calls else "orphan")


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(60)), "en", "ab"[i % 2], 0) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "a", 0) for i in range(5)] + [(200, None, "en", "a", 0), (201, "12 34", "de", "b", 0)]
    passage = " ".join(f"bench{i}" for i in range(20))
    docs += [(300, docs[7][1][:100] + " " + passage, "en", "b", 0)]
    for name, rows, kinds in (("documents", docs, DOCS), ("benchmark", [(0, passage)], "item_id long, text string")):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path)).cache()
        seen[name] = sorted(r.doc_id for r in frame.collect())
        if name != "sharding":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen["language_id"] == sorted([*range(60), *range(100, 105), 300])
    assert seen["near_duplicates"] == [*range(60), 300] and seen["decontamination"] == list(range(60))
    assert set(seen["mixing"]) <= set(range(60)) and seen["sharding"] == seen["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sharding"])


def test_language_stage_follows_the_classifiers(spark):
    import corpus_pipeline

    rng = random.Random(1)
    pools = {"en": ["the", "cat", "house", "with"], "de": ["straße", "über", "nicht", "haus"]}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(12)), k, "s", 1) for i in range(300) for k in [list(pools)[i % 2]]]
    docs = spark.createDataFrame([*rows, (900, "the haus cat nicht " * 3, None, "s", 1), (901, "12", None, "s", 1)], DOCS)
    model = language_id.train(docs)
    judged = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    vague = {i for i, r in judged.items() if r.ambiguous}
    kept = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert set(kept) == {r[0] for r in rows} | {900, 901} - vague and 901 in vague
    # labels stay, and a document without one gets what the classifiers say
    assert all(kept[r[0]] == r[2] for r in rows)
    more = docs.where("doc_id < 300").selectExpr("doc_id + 1000 AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    filled = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs.union(more), "").collect()}
    assert all(filled[r[0] + 1000] == r[2] for r in rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, "").collect()} == {r[0] for r in rows} | {900, 901}


def test_pipeline_stages_on_odd_documents(spark, tmp_path):
    """Nulls, ties, repeated rows, other columns, one source or none, an empty table: each stage keeps the columns."""
    import corpus_pipeline

    bench = spark.createDataFrame([(0, "a passage that no document holds at all")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd_docs(spark).withColumns({"shard": F.lit("x"), "score": F.lit(1), "a": F.lit("y"), "node": F.lit(0)})
    for docs in (odd, odd.limit(0), odd.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))):
        frame = docs
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path)).cache()
            ids = [r.doc_id for r in frame.select("doc_id").collect()]
            if name != "sharding":
                assert frame.columns == docs.columns
        assert {"global_row", "shard", "slot"} <= set(frame.columns) and (ids or docs.isEmpty())
