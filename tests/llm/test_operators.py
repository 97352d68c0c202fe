"""Each operator on a small table with nulls, empty texts, ties, repeated rows and clashing columns, against a slow version."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phaseloom.llm import chat, common, context_tree, exact_dedup, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts, word_bpe
from phaseloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, rep string, fp string, cut string, h int"


def _prose(rnd, n, kind="abcdefg"):
    return " ".join("".join(rnd.choice(kind) for _ in range(rnd.randint(1, 7))) for _ in range(n))


def _texts():
    rnd = random.Random(3)
    shared = _prose(rnd, 70)
    base = _prose(rnd, 200)
    words = base.split()
    near = words.copy()
    near[100] = "changed"
    out = [None, "", " \n\t ", "one", "one", "two words", "Two Words", base, base.replace(" ", "  "), " ".join(near), base.upper()]
    out += [_prose(rnd, 40) + "\n" + shared + "\n" + _prose(rnd, 60) for _ in range(3)]
    out += ["\n".join(["same line here again"] * 30), "#$% " * 80, "é ü ß 日本 " * 30, "a" * 30_000, _prose(rnd, 12_000), "x<|endoftext|>y  z \x1c w"]
    out += [_prose(rnd, rnd.randint(1, 150)) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t, "en" if k % 3 else None, "s", 0, 1, 2, "r", "f", "c", 5) for k, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(rows):
    return {r[0]: r[1] or "" for r in rows}


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_rules(docs, empty, texts):
    found = _by_id(quality_rules.judge(docs))
    assert found.keys() == texts.keys()
    for k, text in texts.items():
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = collections.Counter(windows)
        repeated = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.kept}
    assert found[7].kept and not found[14].kept and not found[15].kept
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_rule_order_changes_nothing(docs):
    some = {r.doc_id for r in quality_rules.keep_good(docs, rules=quality_rules.RULES[::-1]).collect()}
    assert some == {r.doc_id for r in quality_rules.keep_good(docs).collect()}


def test_exact_dedup(spark, docs, empty, monkeypatch):
    con = duckdb.connect()
    table = docs.toArrow()
    con.register("documents", table)
    want = sorted(con.sql(exact_dedup.ORACLE).fetchall())
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).select(columns).collect())) == want
    kept = {r[0] for r in want if r[3]}
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == sorted(kept)
    monkeypatch.setattr(exact_dedup, "_hot", lambda rows: [r.h for r in rows.select(F.xxhash64("norm").alias("h")).distinct().limit(20).collect()])
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).select(columns).collect())) == want
    twice = exact_dedup.drop_duplicates(docs.union(docs))
    assert twice.columns == docs.columns and sorted(r.doc_id for r in twice.collect()) == sorted(kept)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text, n=3):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    parent = {k: k for k in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in prints}


def test_simhash(docs, empty, texts):
    short = {k: t for k, t in texts.items() if len(t) < 5000}
    found = _by_id(simhash.simhash_classes(docs))
    prints = {k: _fingerprint(t) for k, t in short.items()}
    assert all(found[k].fingerprint == format(p, "016x") for k, p in prints.items())
    want = _classes({k: int(r.fingerprint, 16) for k, r in found.items()})
    assert {k: r.component_id for k, r in found.items()} == want
    assert simhash.simhash_classes(empty).count() == 0


@pytest.mark.parametrize("pairs", [64, 2])
def test_simhash_links_at_random(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "CELL_PAIRS", pairs)
    rnd = random.Random(7)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    prints = {k: rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for k in range(400)}
    rows = {}
    for k, p in prints.items():
        rows.setdefault(p, k)
    signed = np.array(list(rows), np.uint64)
    frame = spark.createDataFrame([(int(f), int(c), r) for f, c, r in zip(signed.view(np.int64), simhash.cells(signed).view(np.int64), rows.values(), strict=True)], "fp long, cell long, rep long")
    found = {r.node: r.component for r in components(simhash.link_fingerprints(frame)).collect()}
    want = _classes({r: p for p, r in rows.items()})
    assert {r: found.get(r, r) for r in rows.values()} == want


def test_near_duplicates(docs, empty, texts):
    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    close = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r.node: r.component for r in simhash.near_duplicates(docs).collect()}
    assert (7, 9) in close and all(found[a] == found[b] for a, b in close) and set(found) == {x for p in close for x in p}
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert left == {k for k in texts if found.get(k, k) == k}
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_suffix_dedup(docs, empty, texts):
    found = suffix_dedup.repeated_spans(docs).collect()
    words = {k: t.encode().split() for k, t in texts.items()}
    covered = collections.defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    first, forty = {}, collections.defaultdict(list)
    for k in sorted(words):
        for i in range(len(words[k]) - 39):
            forty[tuple(words[k][i : i + 40])].append((k, i))
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            window = tuple(words[k][i : i + 50])
            if window in first and (first[window][0] != k or first[window][1] + 50 <= i):
                assert len(covered[k] & set(range(i, i + 50))) >= 40
            first.setdefault(window, (k, i))
    for r in found:
        assert any(len(forty[tuple(words[r.doc_id][i : i + 40])]) > 1 for i in range(r.start_word, r.end_word - 39))
    spans = {(r.doc_id, r.start_word, r.end_word) for r in found}
    assert {(12, 40, 110), (13, 40, 110)} <= spans and not any(k == 11 for k, *_ in spans)
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs).collect()}
    for k, t in cut.items():
        kept = [w for i, w in enumerate(words[k]) if i not in covered[k]]
        assert (t or "").encode().split() == kept
    assert set(texts) - set(cut) == {k for k, w in words.items() if w and len(covered[k]) == len(w)}
    assert cut[0] is None and suffix_dedup.cut_repeats(empty).count() == 0


def test_bpe(docs, empty, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = _by_id(word_bpe.encode_documents(docs, with_ids=True))
    for k, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        raw, told = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        r = found[k]
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids), raw, told)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest() and r.decoded_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert word_bpe.encode_documents(empty).count() == 0


def test_bpe_on_odd_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own, rnd = Tokenizer.from_file(path), word_bpe.loaded(path), random.Random(11)
    vocabulary = [t.replace("</w>", "") for t in tokenizer.get_vocab()]
    for _ in range(1500):
        text = "".join(rnd.choices(vocabulary, k=4)) if rnd.random() < 0.5 else "".join(rnd.choice("aeiouthnsr'., é日ΣİǺ") for _ in range(30))
        assert own.encode(text)[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_counts(docs, empty, texts):
    found = _by_id(token_counts.recount(docs))
    counter = token_counts.Counter("byte_bpe_50k")
    for k, text in texts.items():
        assert found[k].tokens_before == len(counter.bpe.plain(text))
    rnd, letters = random.Random(13), list("abc  \n\t'sre12é.,!  ")
    for _ in range(800):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400)))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 2 * rnd.randint(1, 4))))
        edits = [(cuts[j], cuts[j + 1], "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 6)))) for j in range(0, len(cuts) - 1, 2)]
        tree = token_counts.Tree(*counter.parts(text))
        after, _ = token_counts.edit(tree, counter, text, edits)
        assert tree.tokens == len(counter.bpe.plain(after))
    assert token_counts.recount(empty).count() == 0


def test_token_counts_of_given_edits(spark, docs):
    edits = spark.createDataFrame([(7, 10, 40, "new words"), (7, 50, 50, " more"), (0, 0, 0, "into nothing"), (99_999, 0, 1, "no such row")], "doc_id long, start int, end int, replacement string")
    found = _by_id(token_counts.recount_edited(docs, edits))
    text = docs.filter("doc_id = 7").first().text
    plain = token_counts.Counter("byte_bpe_50k").bpe.plain
    assert found[7].tokens_after == len(plain(text[:10] + "new words" + text[40:50] + " more" + text[50:])) and found[7].chars_encoded < len(text)
    assert found[0].tokens_after == len(plain("into nothing")) and found[3].n_edits == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"), (None, 0, "ann", "alone"), (2, 0, "system", "only"), (3, None, "zoë", "é")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit("clash"))
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    got = chat.rotate(table)
    key = lambda r: tuple(map(str, r))
    want = con.sql(chat.ORACLE).to_arrow_table().select(got.columns).to_pylist()
    assert sorted(map(key, (r.asDict().values() for r in got.collect()))) == sorted(key(r.values()) for r in want)
    own = [r for r in got.collect() if r.conv_id == 1 and r.perspective == "ann"]
    assert len(own) == 5 and [r.segment[r.mask_start : r.mask_end] for r in own if r.role == "assistant"] == ["hi<|im_end|>"]
    assert chat.rotate(table.limit(0)).count() == 0


def test_packing(docs, empty, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    pieces = packing.pack(docs).collect()
    held, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        held[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for group, sizes in ((held, {k: len(x) for k, x in ids.items()}), (sequences, None)):
        for k, parts in group.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[k] if sizes else at <= 2048 and at.bit_count() == 1
    assert held.keys() == ids.keys() and packing.pack(empty).count() == 0


def test_packing_cuts_few_ids_anew(spark):
    rnd = random.Random(43)
    texts = [(k, _prose(rnd, int(rnd.paretovariate(1.1) * 25) % 3000 + 1)) for k in range(3000)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    ids = collections.Counter()
    for p in pieces:
        ids[p.sequence_id] += p.length
    assert all(n == 2048 or n.bit_count() == 1 for n in ids.values()) and sum(n < 2048 for n in ids.values()) <= 11
    split = collections.Counter((p.doc_id, p.start // 2048) for p in pieces)
    anew = sum(p.length for p in pieces if split[p.doc_id, p.start // 2048] > 1)
    assert anew < 0.08 * sum(ids.values())


def test_packing_level_is_the_least_sum_of_squares():
    rnd, packer = random.Random(17), packing.Packer(0, 32)
    for doc in range(400):
        n = rnd.randint(1, 32)
        best = {}
        for level in [0, *(h for h in range(1, 32) if packer.count[h] and h + n <= 32)]:
            count = packer.count.copy()
            count[level] -= level > 0
            count[level + n] += level + n < 32
            best[level] = int((count[1:] ** 2).sum())
        assert n == 32 or best[packer.level(n)] == min(best.values())
        packer.place(doc, n)


def test_quality_model(spark, docs, empty):
    rnd = random.Random(19)
    good = [(1000 + k, _prose(rnd, rnd.randint(60, 200)), "en") for k in range(120)]
    bad = [(5000 + k, _prose(rnd, 80, "QXZ#!7"), "en") for k in range(10)]
    extra = [(1, None, "en"), (2, "", None), (3, good[0][1], "xx"), (1000, good[0][1], "en")]
    table = spark.createDataFrame(good + bad + extra, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("value", F.lit(2))
    labels = spark.createDataFrame([(k, 1, 0) for k, *_ in good] + [(5000, 0, None), (1000, 1, None)], "doc_id long, quality int, toxic int")
    found = _by_id(quality_model.classify(table, labels))
    assert len(found) == len(good) + len(bad) + 3
    assert sum(found[k].kept for k, *_ in good) >= 110 and not any(found[k].kept for k, *_ in bad)
    assert not found[1].kept and not found[2].kept and found[1].perplexity is None and found[3].kept
    none = _by_id(quality_model.classify(table, labels.limit(0)))
    assert none[5000].kept and not none[1].kept
    assert quality_model.classify(empty, labels).count() == 0


def test_quality_model_sums_to_one(spark):
    text = spark.createDataFrame([(1, "abracadabra abracadabra cad bra"), (2, "bar car dab")], "id long, text string")
    counts = quality_model.trained_counts(text)
    for context in (b"abra", b"zzzz", b"\0\0\0\0", b"d br"):
        asked = spark.range(256).select((F.lit(int.from_bytes(context, "big") << 8) + F.col("id")).alias("key"))
        total = quality_model.log_probabilities(asked, counts).agg(F.sum(F.pow(F.lit(10.0), "value"))).first()[0]
        assert abs(total - 1) < 1e-9


def _slow_tree(train, texts):
    depth = context_tree.DEPTH
    node = collections.defaultdict(lambda: [0, 0])
    steps = lambda t: ((b[k - depth : k], b[k]) for b in [bytes(depth) + t.encode().translate(bytes(c + 32 * (65 <= c <= 90) for c in range(256))) + b"\0"] for k in range(depth, len(b)))
    for t in train:
        for c, x in steps(t):
            for d in range(depth + 1):
                for j in range(8):
                    node[c[depth - d :], 1 << j | x >> 8 - j][x >> 7 - j & 1] += 1
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in node.items()}
    below = collections.defaultdict(float)
    for c, v in sorted(node, key=lambda k: -len(k[0])):
        mixed = own[c, v] if len(c) == depth else float(np.logaddexp(own[c, v], below[c, v])) - math.log(2)
        if c:
            below[c[1:], v] += mixed

    def score(t):
        total = 0.0
        for c, x in steps(t):
            for j in range(8):
                v, bit, p = 1 << j | x >> 8 - j, x >> 7 - j & 1, None
                for d in range(depth, -1, -1):
                    k = c[depth - d :], v
                    if k in node:
                        chance = (node[k][bit] + 0.5) / (sum(node[k]) + 1)
                        w = 1 / (1 + math.exp(min(700, below[k] - own[k])))
                        p = chance if p is None else w * chance + (1 - w) * p
                total += math.log10(0.5 if p is None else p)
        return total

    return [score(t) for t in texts]


def test_context_tree(spark, docs, empty, texts):
    some = {k: t for k, t in texts.items() if len(t) < 2500}
    found = _by_id(context_tree.score_documents(docs.filter(F.length(F.coalesce("text", F.lit(""))) < 2500)))
    learnt = {k: t for k, t in some.items() if zlib.crc32(str(k).encode()) % 10}
    count = collections.Counter(w for t in learnt.values() for w in [*t.encode().lower().split(), None])
    total, kinds = sum(count.values()), len(count)
    slow = dict(zip(some, _slow_tree(learnt.values(), some.values()), strict=True))
    for k, t in some.items():
        tokens = [*t.encode().lower().split(), None]
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k not in learnt, len(tokens), sum(w in count for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens), rel_tol=1e-9)
        assert math.isclose(r.score, slow[k], rel_tol=1e-8)
    assert context_tree.score_documents(empty).count() == 0


def _near_classes(spark, rows):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: shingles(t) for k, t in rows}
    close = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {x: x for p in close for x in p}
    for _ in want:
        for a, b in close:
            want[a] = want[b] = min(want[a], want[b])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return close, want, {r.node: r.component for r in simhash.near_duplicates(frame).collect()}


@pytest.mark.parametrize("bits", [20, 6])
def test_near_duplicates_of_one_template(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "RARITY_BITS", bits)
    rnd = random.Random(23)
    base, rows = _prose(rnd, 160).split(), []
    for k in range(150):  # chains: a document is near some of the template's others, but seldom near the first
        words = (rows[rnd.randrange(k)][1].split() if k % 20 else base).copy()
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(160)] = _prose(rnd, 1, "xyz")
        rows.append((k, " ".join(words)))
    close, want, got = _near_classes(spark, rows)
    assert len(close) > 100 and got == want


def test_near_duplicates_with_a_repeated_phrase(spark):
    rnd, rows = random.Random(29), []
    for k in range(0, 40, 2):
        text, phrase = _prose(rnd, 300), _prose(rnd, 14)
        rows += [(k, text + " " + phrase), (k + 1, text + " " + " ".join([phrase] * 20))]
    close, want, got = _near_classes(spark, rows)
    assert len(close) == 20 and got == want


def test_near_candidates_grow_in_proportion_to_the_documents(spark):
    """Sentences that 67 documents share, then 133, in no two of them the same ones: more common shingles than a short list holds."""
    rnd = random.Random(37)
    shared = [_prose(rnd, 8) for _ in range(150)]
    rows = [(k, " ".join(x for _ in range(10) for x in (rnd.choice(shared), _prose(rnd, 12)))) for k in range(2400)]
    tried = []
    for n in (1200, 2400):
        marks = simhash.prefix_marks(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(5), "doc_id", "text", 5, 0.8)
        sizes = marks.filter("mark is not null").groupBy("mark").count()
        tried.append(sizes.selectExpr("sum(count * (count - 1))").first()[0] or 0)
    assert tried[1] <= 2.2 * max(tried[0], 1200)


def test_near_duplicates_at_the_bound(spark):
    rnd, rows = random.Random(31), []
    for k in range(0, 400, 2):  # 36 shingles each, 32 of them shared: exactly 0.8
        words = _prose(rnd, 40).split()
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:36], *_prose(rnd, 4, "xyz").split()]))]
    close, want, got = _near_classes(spark, rows)
    assert len(close) == 200 and got == want


def _set_fingerprint(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    hashes = set(simhash.word_shingles(raw, np.array([0, len(raw)]), 5)[0].tolist())
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_come_by_fingerprints(spark, monkeypatch):
    """Without the marks that complete them: all pairs within 5 bits, and only those that the similarity allows."""
    none = spark.createDataFrame([], "mark long, node long, id long, n int, pos int, rep long")
    monkeypatch.setattr(simhash, "prefix_marks", lambda *_: none)
    rnd, rows = random.Random(43), []
    for k in range(0, 120, 2):
        words = _prose(rnd, 200).split()
        other = words.copy()
        for at in rnd.sample(range(200), k % 4 + 1):
            other[at] = "changed"
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    rows += [(120, ""), (121, ""), (122, rows[0][1].upper())]
    prints = {k: _set_fingerprint(t) for k, t in rows if t}
    close, _, got = _near_classes(spark, rows)
    wanted = [(a, b) for a, b in close if (prints.get(a, 0) ^ prints.get(b, 0)).bit_count() <= 5 and a < 120]
    assert len(wanted) > 25 and all(a in got and got[a] == got.get(b) for a, b in wanted)
    assert set(got) <= {x for p in close for x in p if x not in (120, 121)}


def test_near_duplicates_are_checked(spark, monkeypatch):
    """Fingerprints that link unlike texts join nothing, and texts that they tell apart are found all the same."""
    rnd, rows = random.Random(47), []
    for k in range(0, 60, 2):
        words = _prose(rnd, 60).split()
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:56], *_prose(rnd, 4, "xyz").split()]))]
    made = simhash.fingerprint_pairs
    for pairs in (lambda *_: spark.createDataFrame([(k, k // 3) for k in range(1, 60)], "a long, b long"), lambda *_: spark.createDataFrame([], "a long, b long"), made):
        monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *x, pairs=pairs: common.durable(pairs(*x)))
        close, want, got = _near_classes(spark, rows)
        assert len(close) == 30 and got == want


@pytest.mark.parametrize("most", [64, 2, 0])
def test_halves_are_linked_apart(spark, most):
    rnd = random.Random(53)
    centres = [rnd.getrandbits(32) for _ in range(20)]
    prints = {rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(32), rnd.randint(0, 2))) | rnd.randrange(2) << 32: k for k in range(300)}
    rows = {k: p for p, k in prints.items()}
    signed = np.array(list(rows.values()), np.uint64)
    frame = spark.createDataFrame([(int(f), int(c), r) for f, c, r in zip(signed.view(np.int64), simhash.cells(signed).view(np.int64), rows, strict=True)], "fp long, cell long, rep long")
    found = {r.node: r.component for r in components(simhash.link_fingerprints(frame, 32, most)).collect()}
    parts = [_classes({r: p for r, p in rows.items() if p >> 32 == part}) for part in (0, 1)]
    assert {r: found.get(r, r) for r in rows} == parts[0] | parts[1]


@pytest.mark.parametrize("parts", [1, 9])
def test_suffix_dedup_of_variants(spark, parts):
    rnd = random.Random(37)
    notice, rows = _prose(rnd, 70).split(), []
    for k in range(60):  # variants of a notice among exact copies
        own = notice.copy()
        for at in (rnd.sample(range(70), k % 3)):
            own[at] = rnd.choice("XYZ")
        rows.append((k, " ".join([*_prose(rnd, 30).split(), *own, *_prose(rnd, 30).split()])))
    covered = collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect():
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    seen, wanted, forty = {}, collections.defaultdict(set), collections.defaultdict(set)
    for k, text in rows:
        words = text.split()
        for n, to in ((50, wanted), (40, forty)):
            for i in range(len(words) - n + 1):
                window = tuple(words[i : i + n])
                if seen.setdefault(window, k) != k:
                    to[k].update(range(i, i + n))
    assert wanted and all(wanted[k] <= covered[k] <= forty[k] for k, _ in rows)


def test_quality_model_thresholds_of_a_small_language(spark):
    rnd = random.Random(41)
    rows = [(k, _prose(rnd, 20, "ab"), "en") for k in range(1500)] + [(9000 + k, _prose(rnd, 60, "opqrstuvwxyz"), "xx") for k in range(40)]
    labels = spark.createDataFrame([(k, 1, 0) for k, *_ in rows], "doc_id long, quality int, toxic int")
    found = _by_id(quality_model.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, trusted=20))
    assert found[9000].threshold > 2 * found[0].threshold and sum(found[k].kept for k in range(9000, 9040)) >= 38


def _variants(documents: int) -> list[tuple[int, str]]:
    """One passage of 50 words in all documents, and of other words before and after it few or none in common."""
    rnd = random.Random(29)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for k in range(documents):
        left, right = ([f"w{rnd.randrange(10**9)}" for _ in range(15)] for _ in "lr")
        near, far = rnd.randint(0, 12), rnd.randint(0, 12)
        left[15 - near :] = [f"l{i}" for i in range(near, 0, -1)]
        right[:far] = [f"r{i}" for i in range(far)]
        rows.append((k, " ".join(left + passage + right + (passage + right[:3] if k % 5 == 0 else []))))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_dedup_of_crowded_seeds(spark, parts, monkeypatch):
    df = spark.createDataFrame(rows := _variants(400), "doc_id long, text string").repartition(parts)
    monkeypatch.setattr(suffix_dedup, "LOCAL_BYTES", 20_000)
    seeds = {int(s) for _, t in rows for s in suffix_dedup.retained(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[2].view(np.int64)}
    found = [
        {(r.id, r.start, r.end) for r in suffix_dedup._document_spans(df, "doc_id", "text", np.array(crowded, np.int64)).collect()}
        for crowded in ([], sorted(seeds), sorted(seeds)[::2])
    ]
    assert found[0] == found[1] == found[2]
    words = {k: t.split() for k, t in rows}
    for k in range(1, 400):
        at = words[k].index("p0")
        assert any(a <= at and b >= at + 50 for i, a, b in found[0] if i == k)


def test_crowded_seeds_are_found(spark):
    df = spark.createDataFrame(_variants(3000), "doc_id long, text string")
    texts = suffix_dedup.C.texts(df, "doc_id", "text").select("id", "text", suffix_dedup._text_hash(suffix_dedup.F.col("text")).alias("hash"))
    crowded = suffix_dedup.crowded_seeds(texts)
    assert 1 <= len(crowded) < 8 and not len(suffix_dedup.crowded_seeds(texts.limit(0)))
    spans = suffix_dedup.repeated_spans(df)
    assert spans.select("doc_id").distinct().count() == 2999 + spans.filter("doc_id = 0").limit(1).count()
