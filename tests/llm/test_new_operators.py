"""Operators 11 to 13 against brute force, on small, odd and random input, and on the given tables."""

import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from phaseloom.llm import conversation_repair as R
from phaseloom.llm import decontaminate as T
from phaseloom.llm import periodic as P

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- 11 -----------------------------------------------------------------------------------------------------------------


def slow_repair(rows):
    """(counts..., cost, audit, hash) of (turn, role, text) rows in order, by least cost, then text, over all edits."""
    seen, flags = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        flags.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        more = []
        named = "assistant" if state == "u" else "user"
        more.append((2, "I", i, named[0], (named, "")))
        if i < len(rows):
            _, role, text = rows[i]
            more.append((3, "D", i + 1, state, None))
            if flags[i] not in ("blank", "duplicate"):
                extra = flags[i] == "truncated"
                if role[:1] == named[0] or (state == "" and role[:1] == "s"):
                    more.append((extra, "K", i + 1, role[:1], (role, text)))
                for other in ("user", "assistant"):
                    if other == named:
                        more.append((2 + extra, "R", i + 1, named[0], (other, text)))
        for c, edit, j, to, line in more:
            heapq.heappush(heap, (cost + c, audit + edit, j, to, out if line is None else (*out, line)))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(flags.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def slow_damage(rows):
    """{conv_id: rows in order} of (conv_id, turn, role, text) after the query's faults."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def random_turns(rnd, n):
    roles = ["user", "assistant", "system", "tool", "", None]
    return [(rnd.choice([None, *range(n)]) if rnd.random() < 0.3 else k, rnd.choices(roles, [9, 9, 2, 1, 1, 1])[0], rnd.choice(["yes.", "no!", "no stop", " \t", "", None, "Why? ", "é", "x" + str(k) + "."])) for k in range(n)]


def test_op11_against_least_cost_search(spark):
    rnd = random.Random(11)
    rows = [(conv, *turn) for conv in range(300) for turn in random_turns(rnd, rnd.randint(1, 9))]
    rows += [(None, *turn) for turn in random_turns(rnd, 6)] + [(900, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(60)]
    rows += [(901, 0, "user", "a."), (901, 0, "user", "a."), (902, None, "user", None), (903, 2**60, "system", "big " * 1000 + ".")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, CONV string")
    want = {k: slow_repair(v) for k, v in slow_damage(rows).items()}
    turns = R.damaged(df)
    assert got(R.repair(turns)) == want
    # by blocks, each of a few turns, and with every conversation taken as a long one
    assert got(R.repair(turns, long_turns=4, block=3)) == want
    lines = {}
    for r in R.repaired_turns(turns, long_turns=4, block=3).orderBy("conv_id", "place").collect():
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(sha("\n".join(lines.get(k, []))) == v[-1] for k, v in want.items())


def test_op11_of_one_very_long_conversation(spark):
    rnd = random.Random(5)
    rows = [(7, k, "user" if (k + (k > 900)) % 2 == 0 else "assistant", rnd.choice(["fine.", f"turn {k}.", f"cut {k}"])) for k in range(1500)]
    turns = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {k: slow_repair(v) for k, v in slow_damage(rows).items()}
    assert got(R.repair(turns)) == want
    assert got(R.repair(turns, long_turns=100, block=64)) == want
    assert got(R.repair(turns, long_bytes=100, block=64)) == want


def test_op11_on_the_given_table(spark):
    table = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    want = {k: slow_repair(v) for k, v in slow_damage([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table]).items()}
    assert got(R.op11_conversation_repair(spark, SF)) == want


def test_op11_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damaged(empty)).count() == 0 and R.repaired_turns(R.turns_of(empty)).count() == 0


# --- 12 -----------------------------------------------------------------------------------------------------------------


def norm(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_leaks(docs, items, width=10):
    windows = {}
    for name, text in items:
        w = norm(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("null" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, names = norm(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(out, key=repr)


def digests(found):
    rows = [(r.id, r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.n_hit > 0) for r in found.collect()]
    return sorted(rows, key=repr)


def test_op12_against_brute_force(spark):
    rnd = random.Random(12)
    words = ["alpha", "be-ta", "Gamma", "δέλτα", "x9", "Éa", "..", "q"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, say(rnd.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for k in range(25)] + [(None, say(12)), (3, say(14)), (99, None), (98, ""), (97, "!!")]
    docs = [(k, f"{say(rnd.randint(0, 60))}; {(rnd.choice(items)[1] or '').upper()}! {say(5)}") for k in range(120)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (200, None), (201, ""), (202, "alpha " * 30000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, ID int")
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, ITEMS int")
    for width in (10, 3):
        want = slow_leaks(docs, items, width)
        assert digests(T.leaks(df, bench, width=width)) == want
        assert digests(T.leaks(df, bench, width=width, held_bytes=2000)) == want  # a benchmark beyond the bound, in parts
    spans = [(r.id, [tuple(s) for s in r.spans]) for r in T.leaks(df, bench, width=3, held_bytes=2000).collect()]
    assert sorted(spans, key=repr) == sorted([(r.id, [tuple(s) for s in r.spans]) for r in T.leaks(df, bench, width=3).collect()], key=repr)


def test_op12_cuts_spans_or_documents(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = [(1, "Head, One TWO three-four five. six seven eight nine ten eleven! tail of it"), (2, "clean text"), (3, None), (4, "one two three four five six seven eight nine ten")]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, leak_spans string")
    cut = {r.doc_id: r.text for r in T.decontaminate(df, bench).collect()}
    assert cut == {1: "Head, tail of it", 2: "clean text", 3: None, 4: ""}
    left = T.decontaminate(df, bench, cut="documents")
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in T.leaks(df, empty).collect()) and T.leaks(df.limit(0), bench).count() == 0


def test_op12_verifies_words_not_hashes(spark, monkeypatch):
    rows = T.test_windows(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string"), width=3).toArrow()
    held = T.TestSet(rows)
    raw = np.frombuffer(b"a b c d e f", np.uint8)
    t = T.Tokens(raw, np.array([0, len(raw)]))
    assert sorted(int(s[0]) for _, _, s in held.hits(t)) == [0, 3]
    held.words = [w[::-1].copy() for w in held.words]
    assert not list(held.hits(t))


def test_op12_on_the_given_tables(spark):
    read = lambda name, key: [(r[key], r["text"]) for r in pq.read_table(f"{SF}/{name}.parquet", columns=[key, "text"]).to_pylist()]
    rows = T.op12_decontaminate(spark, SF).collect()
    made = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows], key=repr)
    assert made == slow_leaks(read("documents", "doc_id"), read("benchmark", "item_id"))


# --- 13 -----------------------------------------------------------------------------------------------------------------


def slow_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            own = w[i : i + length]
            least = next(p for p in range(1, q + 1) if all(own[k] == own[k + p] for k in range(length - p)))
            if length >= max(6, 4 * q) and least == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def slow_periodic(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(w)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    more = (None, None, None, None) if top is None else (*top, 1000 * top[1] // top[2])
    return (doc, len(found), *more, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_op13_runs_of_random_words(seed):
    rnd = random.Random(seed)
    docs = []
    for _ in range(150):
        parts = []
        while len(parts) < rnd.randint(0, 90):
            unit = [rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, 9))]
            parts += unit * rnd.randint(1, 12) + unit[: rnd.randint(0, len(unit))]
        docs.append(parts)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    x = np.array([(k << 20) + v for k, d in enumerate(docs) for v in d], np.uint64)
    want = [(a + int(at[k]), n, q) for k, d in enumerate(docs) for a, n, q in slow_runs(d)]
    assert [tuple(r) for r in P.runs(x, at).tolist()] == want


def test_op13_fibonacci_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    for words in (b, [7] * 2000, [1, 2] * 700 + [1] + [3] * 5, []):
        x = np.array(words, np.uint64)
        want = slow_runs(words) if len(words) < 2500 else []  # no fourth power in that word
        assert [tuple(r) for r in P.runs(x, np.array([0, len(x)])).tolist()] == want


def test_op13_wavelet_matrix():
    rnd = np.random.default_rng(3)
    values = rnd.permutation(300)
    tree = P.WaveletMatrix(values, 9)
    low, high, bound = (np.array(x) for x in zip(*[(a, b, c) for a in range(0, 300, 37) for b in range(a + 1, 301, 41) for c in (0, 17, 150, 299, 400)], strict=True))
    assert tree.less(low, high, bound).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(low, high, bound, strict=True)]
    k = (high - low) // 2
    assert tree.kth(low, high, k).tolist() == [int(np.sort(values[a:b])[j]) for a, b, j in zip(low, high, k, strict=True)]


def test_op13_on_given_and_odd_rows(spark, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs = [d for d in docs if len(d[1]) < 6000] + [(None, "a b " * 9), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "x " * 3000), (1003, "x " * 3000), (12, "é ü " * 50), (1004, "w" * 3_000_000 + " a a a a a a a")]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, RUNS int, collapsed string").write.parquet(f"{path}/documents.parquet")
    rows = P.op13_periodic_runs(spark, path).collect()
    assert sorted([tuple(r) for r in rows], key=repr) == sorted([slow_periodic(*d) for d in docs], key=repr)
    plain = {r.doc_id: r for r in P.periodic_runs(spark.createDataFrame([(1, "go a b a b a b a b end"), (2, None)], "doc_id long, text string")).collect()}
    assert plain[1].collapsed == "go a b end" and [tuple(x) for x in plain[1].runs] == [(1, 8, 2)] and plain[2].collapsed == "" and plain[2].runs == []
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
