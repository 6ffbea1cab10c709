"""Periodic runs, conversation repair and the grid join against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import conversation_repair, grid_join, periodic
from newsloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------------


def runs_of(words):
    """(start, end) to smallest period, by trying every period at every place."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, q, b) for (a, b), q in out.items())


def runs_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, words
        p = 1 + (n - a) // (3 + g % 8)
        words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    gone = {i for a, q, b in runs for i in range(a + q, b)}
    best = max(runs, key=lambda r: (r[2] - r[0], -r[0], -r[1]), default=None)
    longest = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    lines = "".join(f"{a},{b - a},{q}\n" for a, q, b in runs)
    return (doc_id, len(runs), *longest, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_numbers():
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 90))
            x = rng.integers(0, rng.integers(1, 4), n)
            if n and rng.random() < 0.5:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 12))
                x = np.array([x[i] if i < a else x[min(a + (i - a) % p, n - 1)] for i in range(n)])
            texts.append(x)
        ends = np.r_[0, np.cumsum([len(x) for x in texts])]
        want = [(a + e, b + e, q) for x, e in zip(texts, ends.tolist(), strict=False) for a, q, b in runs_of(x.tolist())]
        assert [tuple(r) for r in periodic.find_runs(np.concatenate(texts), ends).tolist()] == want
        assert [tuple(r) for x in texts for r in sorted(periodic.direct(x).tolist(), key=lambda r: (r[0], r[2]))] == [(a, b, q) for x in texts for a, q, b in runs_of(x.tolist())]


def test_colliding_hashes_are_found_out(monkeypatch):
    """With hashes that are all equal, the words still decide."""
    monkeypatch.setattr(periodic.Prefixes, "same", lambda self, at, q, size: np.ones(len(at), bool))
    rng = np.random.default_rng(2)
    x = np.r_[rng.integers(0, 2, 60), np.tile([5, 6], 9), rng.integers(0, 2, 60)]
    assert [tuple(r) for r in periodic.find_runs(x, np.array([0, len(x)])).tolist()] == [(a, b, q) for a, q, b in runs_of(x.tolist())]


def test_runs_of_very_long_texts():
    x = np.zeros(300_000, np.int64)
    assert periodic.find_runs(x, np.array([0, len(x)])).tolist() == [[0, len(x), 1]]


def test_op11(spark, odd, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = [(-i, " ".join(random.Random(i).choices("abcd", k=i % 70)) + " \n" * (i % 3), "x") for i in range(1, 300)]
    more = spark.createDataFrame(planted, "doc_id long, text string, runs string")
    for df in (docs, odd, more):
        want = sorted((runs_row(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        got = periodic.digest(periodic.periodic_runs(periodic.damaged(df)))
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] > 0 for r in (runs_row(d, t) for d, t, _ in planted)) > 20
    assert periodic.digest(periodic.periodic_runs(periodic.damaged(no_docs))).count() == 0
    assert QUERIES["op11_periodic_runs"](spark, SF).count() == docs.count()


# --- conversation repair -------------------------------------------------------------------------

KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """(cost, audit, roles and texts) with the least cost, then audit, by Dijkstra over whole audits. rows: role, text, fault."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, made
        if (i, state) in seen:
            continue
        seen.add((i, state))
        name = {2: "user", 3: "assistant"}[NEXT[state]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state], (*made, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, NEXT[state], (*made, (name, text))))
                if (state, role[:1]) in KEEP:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, KEEP[state, role[:1]], (*made, (role, text))))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def repairs(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, found in of.items():
        found.sort()
        seen, faults = set(), []
        for _, _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for has, t, _, _ in found if has]
        initials = [r[2][:1] for r in found]
        cost, audit, made = cheapest([(r[2], r[3], f) for r, f in zip(found, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))
    return out


def repaired(rows):
    done = repairs(damage(rows))
    return sorted((done.get(c, (c, 0, 0, 0, 0, 0, 0, "", sha(""))) for c in {r[0] for r in rows}), key=str)


def made_up(n, seed):
    rng = random.Random(seed)
    texts = ["Good.", "Fine!", "cut off", "", " \t", "Why? ", None, "Ünï."]
    return [(rng.choice([None, *range(n // 6)]) if seed % 2 else rng.randrange(n // 6), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("size", [4096, 3])
def test_op12(spark, size):
    """Whole conversations, and ones of many segments in several tasks."""
    source = spark.read.parquet(f"{SF}/conversations.parquet")
    given = [tuple(r) for r in source.select("conv_id", "turn", "role", "text").collect()]
    rows = made_up(900, 1) + made_up(300, 2)
    long = [(5000, i, random.Random(i).choice(["user", "assistant"]), f"Text {i % 61}" + "." * (i % 3 > 0)) for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows + long], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = conversation_repair.audit_damaged(df, size)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == repaired(rows + long)
    if size > 4:
        assert sorted(map(tuple, QUERIES["op12_conversation_repair"](spark, SF).collect()), key=str) == repaired(given)
        assert conversation_repair.audit_damaged(df.where("false")).count() == 0


def test_segments_run_in_workers(spark):
    """Segments of few rows in one task, through the sweeps, equal one walk."""
    rng = random.Random(4)
    codes = [bytes(rng.choice([0, 1, 2, 1, 2, 3]) | rng.choice([0, 0, 0, 1, 2, 3]) << 2 for _ in range(rng.randint(1, 5))) for _ in range(40)]
    whole = b"".join(codes)
    far, end = conversation_repair.FAR, list(conversation_repair.END)
    audit, last = conversation_repair.walk(whole, 0, [0, far, far, far], end)
    several = spark.createDataFrame([(1, i // 7, i % 7, c, i == len(codes) - 1) for i, c in enumerate(codes)], "conv_id long, pid int, idx int, codes binary, final boolean")
    found = sorted(conversation_repair.bounds(several).collect(), key=lambda r: (r.pid, r.idx))
    parts = [conversation_repair.walk(c, r.state, list(r.entry), list(r.leave)) for c, r in zip(codes, found, strict=True)]
    assert "".join(p[0] for p in parts) == audit and parts[-1][1] == last
    assert [p[1] for p in parts[:-1]] == [r.state for r in found[1:]]


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "And?"), (1, 2, "user", ""), (2, 0, "system", "Be good.")]
    out = conversation_repair.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "pid", "idx", "seq").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in out] == [(1, "I", "user", ""), (1, "K", "assistant", "Hi."), (1, "K", "user", "And?"), (1, "I", "assistant", "")]


# --- grid join -----------------------------------------------------------------------------------


def links_of(rows):
    """vec_id, n_links, component_id, kept of (vec_id, vector) rows, by comparing all."""
    good = [v is not None and k is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for k, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good, strict=True)]
    near = [[j for j, y in enumerate(unit) if i != j and x is not None and y is not None and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9] for i, x in enumerate(unit)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= dict.fromkeys(group, min((rows[j][0] for j in group), key=lambda v: (v is None, v)))
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def clumps(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k, (a, b) in enumerate([(0, n // 3), (n // 3, n // 2), (n // 2, n // 2 + 20)]):
        x[a:b] = x[a] + rng.normal(size=(b - a, dim)) * [0.05, 0.22, 0][k]
    return x * rng.choice([1e-3, 1, 1e200], (n, 1))


@pytest.mark.parametrize("block", [2 << 20, 4096])
def test_op13(spark, block):
    """One tile, and many tiles in several levels; copies, tight and loose clumps, sizes far apart."""
    old, grid_join.BLOCK_BYTES = grid_join.BLOCK_BYTES, block
    try:
        rng = np.random.default_rng(0)
        order = rng.permutation(700)
        rows = [(int(i), v.tolist()) for i, v in zip(order, clumps(700, 12, 3), strict=True)]
        rows += [(9000 + i, None if i == 0 else []) for i in range(2)] + [(9002, [0.0] * 12), (9003, [1.0, None]), (9004, [float("nan")] * 12), (9005, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (3, rows[0][1]), (3, rows[0][1])]
        rows += [(9100 + i, [1.0, 0.1 * i]) for i in range(6)] + [(9200, [-2.0]), (9201, [3.0]), (9202, [5.0])]
        df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int").repartition(4)
        got = [(r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in grid_join.near_duplicates(df).collect()]
        want = [(a, b, c, True if a is None else d) for a, b, c, d in links_of(rows)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert grid_join.near_duplicates(df.where("false")).count() == 0
    finally:
        grid_join.BLOCK_BYTES = old


def test_op13_given(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    copies = [(100_000 + i, (np.array(v) * (1 + 0.02 * (np.arange(len(v)) % 3))).tolist()) for i, v in given[:40]]
    df = spark.createDataFrame(given + copies, "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    assert sorted((tuple(r) for r in grid_join.near_duplicates(df).collect()), key=str) == links_of(rows)
    assert QUERIES["op13_grid_join"](spark, SF).count() == len(given)
