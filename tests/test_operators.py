"""Examples and sequential models for the operators SQL does not cover."""

import datetime
import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberweave.catalog import common
from amberweave.functions import policy, vectors
from amberweave.functions import text as tx
from amberweave.operators import contrast, graph, hotset, maintenance, sharing, store
from amberweave.plans import crypto, ingest, models, retrieve, scheduler, stability
from amberweave.sources import tables
from amberweave.streaming import activity as st


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def pack(text, budget):
    """Greedy chunking, word by word, as a plain loop."""
    import re

    out, held = [], []
    for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text).strip()):
        w = s.split()
        if not w:
            continue
        if len(w) > budget:
            if held:
                out.append(held)
            out += [w[i : i + budget] for i in range(0, len(w), budget)]
            held = []
        elif len(held) + len(w) > budget:
            out.append(held)
            held = w
        else:
            held = held + w
    return [" ".join(x) for x in [*out, *([held] if held else [])]]


@pytest.mark.parametrize("budget", [5, 7, 10, 256])
def test_chunks(spark, budget):
    texts = ["", "  \n ", "One two. Three four five six! Seven?", "a b c d e f g h i j k l m n o p q", "x. " * 30, "A long sentence that goes on and on and on. Short one."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.chunks(F.col("t"), budget).alias("c"))
    assert {r["i"]: r["c"] for r in df.collect()} == {i: pack(t, budget) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        tx.chunks(F.lit(""), 0)


def test_eligibility(spark):
    cases = {
        "my password: hunter2 is secret here": "pii_credentials", "the api_key=abcdef is in this text": "pii_credentials", "send Bearer abc.def-ghi with the call": "pii_credentials",
        "card 4111111111111111 was charged": "pii_financial", "her number is 123-45-6789 as she said": "pii_identity", "write to some.one@example.com please": "pii_identity",
        "the diagnosis was clear to all of them": "pii_health", "hi": "no_public_interest", "é123-45-6789 is found after a letter": "pii_identity", "a123-45-6789 is not a number here": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", tx.eligibility(F.col("t")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_ids(spark):
    df = spark.createDataFrame([("abc",)], "t string").select(tx.text_id(F.col("t")).alias("h"))
    assert df.first()["h"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_hash_embedding(spark):
    import hashlib

    text = "naïve ☃ text" * 9
    raw = text.encode()
    raw += b"\0" * (-len(raw) % 64)
    want = b"".join(hashlib.sha256(raw + k.to_bytes(4, "big")).digest() for k in range(2))[:40]
    got = spark.createDataFrame([(text,)], "t string").select(tx.hash_embedding(F.col("t"), 40).alias("v")).first()["v"]
    assert got == pytest.approx([b / 127.5 - 1 for b in want])


def test_bfs_and_path(spark):
    e = spark.createDataFrame([("abc", "def", 0.1), ("abc", "ghi", 0.3), ("def", "abc", 0.1)], "page_id string, neighbor_id string, distance double")
    seed = spark.createDataFrame([("abc",)], "id string")
    n, x = graph.bfs(e, seed, 0)
    assert n.count() == 1 and x.count() == 0
    n, x = graph.bfs(e, seed, 1)
    assert rows(n, "id") == [("abc",), ("def",), ("ghi",)] and x.count() == 2

    def path(nodes, edges):
        n = spark.createDataFrame([(i,) for i in nodes], "id string")
        return [r["id"] for r in graph.greedy_path(n, spark.createDataFrame(edges, "from_id string, to_id string, distance double")).orderBy("step").collect()]

    assert path("abc", [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 10.0)]) == ["a", "b", "c"]
    assert path("abc", [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 0.5)]) == ["a", "b", "c"]
    assert path("abcd", [("c", "d", 0.1)]) == ["a", "b", "c", "d"]


def test_label_propagation(spark):
    def model(adj):
        label = {n: n for n in adj}
        for _ in range(20):
            moved = False
            for n in sorted(adj):
                votes = {}
                for m in adj[n]:
                    votes[label[m]] = votes.get(label[m], 0) + 1
                if votes:
                    best = min(votes, key=lambda v: (-votes[v], v))
                    moved |= best != label[n]
                    label[n] = best
            if not moved:
                break
        return label

    rnd = random.Random(5)
    pairs = {(a, b) for _ in range(60) for a, b in [rnd.sample(range(40), 2)]}
    adj = {n: sorted(b for a, b in pairs if a == n) for n in {x for p in pairs for x in p}}
    df = spark.createDataFrame(sorted(pairs), "page_id long, neighbor_id long")
    assert dict(rows(graph.label_propagation(df), "page_id", "label")) == model(adj)
    cliques = [(a, b) for g in ("abc", "xyz") for a in g for b in g if a != b]
    df = spark.createDataFrame(cliques, "page_id string, neighbor_id string")
    assert len({r[1] for r in rows(graph.label_propagation(df), "page_id", "label")}) == 2


HOT = "entity_id string, tier string, salience double, community_id string"
CAND = "page_id string, salience double, community_id string"


def test_sweep(spark):
    big = spark.createDataFrame([(f"b{i}", "page", s, "big") for i, s in enumerate((0.1, 0.2, 0.3))], HOT)
    out = hotset.promotion_sweep(big, spark.createDataFrame([("new", 5.0, "small")], CAND), c=0.01)
    kept = rows(out, "entity_id", "community_id")
    assert ("new", "small") in kept and sum(c == "big" for _, c in kept) < 3
    four = spark.createDataFrame([(f"p{i}", "page", s, None) for i, s in enumerate((0.5, 0.6, 0.7, 0.8))], HOT)
    out = hotset.promotion_sweep(four, spark.createDataFrame([("weak", 0.1, None)], CAND), c=2)
    assert rows(out, "entity_id") == [("p0",), ("p1",), ("p2",), ("p3",)]
    assert hotset.promotion_sweep(spark.createDataFrame([], HOT), spark.createDataFrame([], CAND)).count() == 0


def test_edges(spark):
    now = F.to_timestamp(F.lit("2024-01-01"))
    e = spark.createDataFrame([("a", "b", 0.5, None), ("a", "c", 0.005, None)], "from_page_id string, to_page_id string, weight double, last_updated_at timestamp")
    t = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "from_page_id string, to_page_id string")
    out = {(r["from_page_id"], r["to_page_id"]): r["weight"] for r in maintenance.strengthen(e, t, now, 0.1).collect()}
    assert out == {("a", "b"): pytest.approx(0.6), ("a", "c"): 0.005, ("c", "d"): 0.1}
    assert rows(maintenance.decay(e, 5), "to_page_id") == [("b",)]


def test_edges_of_tied_lines(spark, tmp_path):
    """Lines of one order, number and part: the one shipped later comes last, in whatever order they are stored."""
    new, old = datetime.datetime(2001, 1, 1), datetime.datetime(1995, 1, 1)
    lines = [(1, 5, 1, new), (1, 5, 1, old), (1, 7, 2, old)]
    for k, stored in enumerate((lines, lines[::-1])):
        spark.createDataFrame(stored, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / f"{k}/lineitem.parquet"))
        assert rows(common.part_edges(spark, str(tmp_path / str(k))).withColumn("year", F.year("last_updated_at")), "from_page_id", "to_page_id", "year") == [(5, 7, 2001)]


def test_probe(spark):
    def run(cands, query, protected):
        df = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in cands], "id long, pos long, v array<double>")
        return contrast.probe(df, query, protected).first()

    e1 = [1.0] + [0.0] * 7
    r = run([(1, [0.9, 0.1] + [0.0] * 6), (2, [-1.0, 0, 0, 0, 1.0, 0, 0, 0])], e1, 4)
    assert (r["thesis"], r["antithesis"], r["knowledge_gap"]) == (1, 2, False)
    r = run([(1, [1.0, 2, 3, 4, 1, 0, 0, 0]), (2, [0.0, 0, 0, 0, -1, 0, 0, 0])], e1, 4)
    assert r["synthesis"] == [1, 2, 3, 4, 0, 0, 0, 0]
    assert run([], e1, 4)["knowledge_gap"] and run([], e1, 4)["thesis"] is None
    assert run([(1, e1)], e1, None)["knowledge_gap"] and run([(7, e1)], e1, 4)["thesis"] == 7


def test_store(spark):
    e = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 5.0), ("b", 1, 1.0)], "k string, seq int, x double")
    assert rows(store.upsert(e, ["k"], "seq"), "k", "x") == [("a", 5.0), ("b", 1.0)]
    shelf = spark.createDataFrame([("s", ["v1", "v2", "v3"]), ("t", ["v9"])], "shelf_id string, volume_ids array<string>")
    gone = spark.createDataFrame([("v2", ["n1", "n2"])], "old_id string, new_ids array<string>")
    assert dict(rows(maintenance.replace_in_shelves(shelf, gone), "shelf_id", "volume_ids")) == {"s": ["v1", "v3", "n1", "n2"], "t": ["v9"]}


def test_bootstrap(spark, tmp_path):
    tables.bootstrap(spark, str(tmp_path))
    assert tables.read(spark, str(tmp_path), "edges").count() == 0


def test_import(spark):
    good = "a page of some length"
    import hashlib

    h = hashlib.sha256(good.encode()).hexdigest()
    pages = spark.createDataFrame([(h, good, h, 4, "k", "s"), ("x", "other", "x", 4, "k", "s"), ("y", "z", "y", 0, "k", "s")], "page_id string, content string, content_hash string, embedding_dim int, creator_pub_key string, signature string")
    edges = spark.createDataFrame([(h, h, 1.0), (h, "x", 1.0), (h, h, -1.0)], "from_page_id string, to_page_id string, weight double")
    own, kept, rejects = sharing.import_slice(pages, edges, verify_hashes=True)
    assert rows(own, "page_id", "embedding_dim", "signature") == [(h, 0, "")] and kept.count() == 1 and rows(rejects, "page_id") == [("x",), ("y",)]
    own, kept, _ = sharing.import_slice(pages, edges)
    assert own.count() == 2 and kept.count() == 2


def test_signatures(spark):
    public, private = crypto.keypair(spark)
    s = crypto.sign(spark, "text", private)
    assert crypto.verify(spark, "text", s, public) and not crypto.verify(spark, "Text", s, public) and not crypto.verify(spark, "text", "AAAA", public)


def test_models():
    r = models.builtin()
    p = r.resolve("BUILTIN-768")
    assert (p.dimension, p.protected_dim, p.source) == (768, 128, "registry") and r.resolve("builtin-768", dimension=64).source == "mixed"
    with pytest.raises(KeyError):
        r.resolve("unknown")
    with pytest.raises(ValueError):
        models.ModelProfile("m", 0, 10)
    assert models.Providers().resolve()[0] == "hash"


def test_scheduler():
    seen, errors = [], []
    s = scheduler.IdleScheduler(on_error=lambda n, e: errors.append(n))
    s.enqueue("low", lambda: seen.append("low"))
    s.enqueue("bad", lambda: 1 / 0, priority=5)
    s.enqueue("high", lambda: seen.append("high"), priority=1)
    assert s.run_all() == 3 and seen == ["high", "low"] and errors == ["bad"]
    s.stop()
    with pytest.raises(RuntimeError):
        s.enqueue("x", lambda: None)


def test_broadcaster():
    sent = []
    b = st.Broadcaster(sent.append, size=2)
    for i in range(3):
        b.push(i)
    assert [b.tick(0.0), b.tick(1.0), b.tick(5.0), b.tick(10.0)] == [True, False, True, False] and sent == [1, 2]


def test_limited_stream(spark, tmp_path):
    src = spark.range(10).selectExpr("'k' key", "timestamp_seconds(id * 2) ts", "cast(id as string) value")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = st.run_available(st.limited(stream, "key", "ts", "value"), "limited", "append")
    assert rows(out, "value") == [("0",), ("3",), ("6",), ("9",)]


def test_retrieve(spark):
    docs = spark.createDataFrame([(1, "Stars shine in the sky. Planets turn around stars."), (2, "Cells divide. Plants grow in the soil."), (3, "")], "doc_id long, text string")
    p = ingest.pages_of(docs, 8, F.to_timestamp(F.lit("2024-01-01")), dim=32)
    p = ingest.checked(p, 32).cache()
    asked = p.where("doc = 2 and pos = 0").first()
    hot = spark.createDataFrame([], HOT)
    nb = spark.createDataFrame([], "page_id string, neighbor_id string, distance double")
    got = retrieve.retrieve(p.select("page_id", "v"), hot, nb, asked["v"], k=2)
    assert got.pages.orderBy(F.desc("score")).first()["id"] == asked["page_id"] and got.path.count() == 2
    act = ingest.start_activity(p)
    hits = got.pages
    assert retrieve.record_hits(act, hits, F.to_timestamp(F.lit("2024-02-01"))).where("query_hit_count = 1").count() == 2


def test_ingest_to_retrieve_on_page_ids(spark, tmp_path):
    """Documents through every table to a query that routes from residents; ids are text all the way."""
    subjects = {"sky": "stars planets moons comets orbit light dark night telescope galaxy", "life": "cells plants leaves roots water soil seeds growth animals forest", "past": "kings wars castles trade ships maps cities letters coins roads"}
    docs = [(k, ". ".join(" ".join(f"{w}{i % 7}" for w in words.split()[i % 3 :]) for i in range(12)) + ".") for k, words in enumerate(subjects.values())]
    now = F.to_timestamp(F.lit("2024-01-01"))
    made = ingest.ingest(spark.createDataFrame(docs, "doc_id long, text string"), 8, now, dim=32, max_distance=1.0)
    ingest.store(made, str(tmp_path))
    t = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in made}
    pages = t["pages"].orderBy("doc", "pos").collect()
    assert [p["embedding_offset"] for p in pages] == [4 * 32 * i for i in range(len(pages))] and all(p["embedding_dim"] == 32 for p in pages)
    for p in pages:
        assert p["page_id"] == hashlib.sha256(p["content"].encode()).hexdigest()
        assert p["vector_hash"] == hashlib.sha256(struct.pack("<32f", *p["v"])).hexdigest()
    ids = {p["page_id"] for p in pages}
    assert {r["page_id"] for r in t["page_activity"].collect()} == ids == {r["page_id"] for r in t["book_pages"].collect()}
    v = {p["page_id"]: np.array(p["v"]) for p in pages}
    degree = policy.neighbor_degree(len(ids))
    cos = lambda a, b: round(float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])), 6)
    near = {a: sorted(((-cos(a, b), b) for b in ids if b != a and cos(a, b) >= 0), key=lambda x: x)[:degree] for a in ids}
    want = {(a, b) for a, bs in near.items() for _, b in bs} | {(b, a) for a, bs in near.items() for _, b in bs}
    listed = {(r["page_id"], r["neighbor_id"]) for r in t["neighbors"].collect()}
    assert listed <= want and {(a, b) for a, bs in near.items() for _, b in bs[:1]} <= want
    assert {r["volume_id"] for r in t["flags"].where("needs_recalc").collect()} == {r["volume_id"] for r in t["volumes"].collect()}
    shelf = t["shelves"].select(F.col("shelf_id").alias("entity_id"), F.lit("shelf").alias("tier"))
    book = t["books"].limit(1).select(F.col("book_id").alias("entity_id"), F.lit("book").alias("tier"))
    asked = pages[5]
    page = spark.createDataFrame([(asked["page_id"], "page")], "entity_id string, tier string")  # the route alone may miss it
    got = retrieve.retrieve(t["pages"].select("page_id", "v"), shelf.unionByName(book).unionByName(page), t["neighbors"], list(asked["v"]), k=3, protected=8, tree=t)
    best = got.pages.orderBy(F.desc("score"), "id").collect()
    assert best[0]["id"] == asked["page_id"] and len(best) == 3
    probe = got.probe.first()
    assert probe["thesis"] == asked["page_id"] and not probe["knowledge_gap"] and probe["antithesis"] in ids
    assert got.path.count() == got.nodes.count() >= 3


def test_nearest_by_all_pairs(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(300, 8))
    v[7] = v[3]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    for name in (str, int):
        ids = [f"p{i:03d}" if name is str else i for i in range(300)]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)] + [(None, v[0].tolist())], f"id {'string' if name is str else 'long'}, v array<double>")
        got = {}
        for r in vectors.nearest(df, df.limit(40), 5, 0.1, skip_self=True).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for q in range(40):
            hits = sorted((-s[q, j], ids[j]) for j in range(300) if j != q and s[q, j] >= 0.1)[:5]
            assert [i for _, i in sorted(got.get(ids[q], []))] == [i for _, i in hits]
    assert vectors.nearest(df, df.limit(0)).count() == 0


def stable_cycle(volumes, shelves):
    """The cycle one volume after another: (volumes as sets of books, shelves as lists of those)."""
    held = {v[0]: list(v[1]) for v in volumes}
    spread = {v[0]: v[3] for v in volumes}
    rows = {k: list(ids) for k, ids in shelves}
    replace = lambda old, new: [ids.__setitem__(slice(None), [x for x in ids if x != old] + new) for ids in rows.values() if old in ids]
    for v in [v[0] for v in volumes]:
        if spread[v] > 0.5 and len(held[v]) >= 2:
            b = held.pop(v)
            half = -(-len(b) // 2)
            new = [("split", v, 0), ("split", v, 1)]
            held[new[0]], held[new[1]] = b[:half], b[half:]
            replace(v, new)
    order, merged = [v for ids in rows.values() for v in ids], set()
    for v in order:
        if len(held.get(v, [0, 0])) >= 2 or v in merged:
            continue
        best = None
        for w in order:
            if w != v and w not in merged:
                n = len(set(held[w]) & set(held[v]))
                if n and (best is None or n > best[0]):
                    best = (n, w)
        if best is None:
            continue
        w = best[1]
        held["merge", w, v] = list(dict.fromkeys([*held[w], *held[v]]))
        merged |= {v, w}
        replace(v, [("merge", w, v)])
        replace(w, [])
    return sorted(sorted(b) for k, b in held.items() if k not in merged), rows, held


def test_stability_cycle(spark):
    rnd = random.Random(6)
    books = [f"b{i}" for i in range(14)]
    for trial in range(3):
        volumes = []
        for i in range(18):  # ids of halves are digests of their books, so those are held by one volume alone
            wide = rnd.random() < 0.3
            own = [f"u{i}{j}" for j in range(rnd.choice([2, 3]))] if wide else rnd.sample(books, rnd.choice([1, 1, 2, 3]))
            volumes.append((f"v{i:02d}", own, [[1.0]], 0.9 if wide else 0.1))
        shelves = [(f"s{2 - k}", k, [v[0] for v in volumes[k * 6 : k * 6 + 6]]) for k in range(3)]
        want, rows, held = stable_cycle(volumes, [(i, ids) for i, _, ids in shelves])
        vdf = spark.createDataFrame(volumes, "volume_id string, book_ids array<string>, prototypes array<array<double>>, variance double")
        sdf = spark.createDataFrame(shelves, "shelf_id string, pos long, volume_ids array<string>")
        every = {b for v in volumes for b in v[1]}
        pages = spark.createDataFrame([(b, "p" + b) for b in every], "book_id string, page_id string")
        act = spark.createDataFrame([("p" + b, "old") for b in every], "page_id string, community_id string")
        out = stability.run(vdf, sdf, pages, act)
        got = {r["volume_id"]: r["book_ids"] for r in out["volumes"].collect()}
        assert sorted(sorted(b) for b in got.values()) == want
        for r in out["shelves"].collect():
            assert sorted(sorted(got[i]) for i in r["volume_ids"]) == sorted(sorted(held[i]) for i in rows[r["shelf_id"]])
        counts = out["counts"].first()
        assert counts["splits"] == sum(v[3] > 0.5 for v in volumes) and counts["merges"] == sum(k[0] == "merge" for k in held if isinstance(k, tuple))
        changed = {r["page_id"] for r in out["activity"].where("community_id != 'old'").collect()}
        touched = {"p" + b for k, bs in held.items() if isinstance(k, tuple) for b in bs}
        assert changed == touched


def test_decay_counts_and_routing(spark):
    edges = spark.createDataFrame([("a", "b", 0.5, None), ("a", "c", 0.0101, None), ("x", "b", 0.9, None)], "from_page_id string, to_page_id string, weight double, last_updated_at timestamp")
    pages = spark.createDataFrame([("a",)], "page_id string")
    kept = maintenance.decay(edges, 32, pages=pages)
    assert [(r["from_page_id"], r["to_page_id"]) for r in kept.collect()] == [("a", "b")]
    assert tuple(maintenance.decay_counts(edges, kept, pages).first()) == (2, 1)
    profile, routing = models.routing_policy(models.builtin(), "builtin-768")
    assert profile.dimension == 768 and routing["broad"]["dim_out"] == 96 and routing["narrow"]["offset"] == 768 * (96 + 192)


def test_slice_travels(spark):
    """An exported slice as one message, and back: the receiver's valid pages carry no identity."""
    texts = ["a public page about stars and planets in the sky", "password: hunter2 is not for sharing at all", "another public page about the soil and its plants"]
    ids = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    pages = spark.createDataFrame([(i, t, i, 8, "key", "sig") for i, t in zip(ids, texts)], "page_id string, content string, content_hash string, embedding_dim int, creator_pub_key string, signature string")
    nb = spark.createDataFrame([(ids[0], ids[1], 0.1, 1), (ids[0], ids[2], 0.2, 2)], "page_id string, neighbor_id string, distance double, rank int")
    edges = spark.createDataFrame([(ids[0], ids[2], 0.5)], "from_page_id string, to_page_id string, weight double")
    seeds = spark.createDataFrame([(ids[0], 0)], "id string, pos int")
    nodes, inner = sharing.export_slice(pages, nb, edges, seeds, "peer-1")
    message = sharing.slice_message(nodes, inner, "peer-1", "2024-01-01T00:00:00Z").first()
    assert {n["page_id"] for n in message["nodes"]} == {ids[0], ids[2]} and set(message["provenance"].values()) == {"peer-1"}
    assert len(message["slice_id"]) == 36 and len(message["edges"]) == 1
    back = spark.createDataFrame([tuple(n) for n in message["nodes"]], nodes.schema)
    own, kept, rejects = sharing.import_slice(back, spark.createDataFrame([tuple(e) for e in message["edges"]], inner.schema), verify_hashes=True)
    assert own.count() == 2 and kept.count() == 1 and rejects.count() == 0 and own.where("creator_pub_key != ''").count() == 0
