"""Document operators against brute force, with nulls, empty texts, ties and extra columns."""

import collections
import hashlib
import math
import os
import random
import re
import tempfile
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from stayrate.llm import decontaminate, exact_dedup, mixing, near_dedup, sharding, suffix_dedup, suffix_sort, toxicity
from tests.conftest import plan_of

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, source string, size long, key string, n long, id string"


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(1, 7)))
    base = [word() for _ in range(120)]
    texts = [None, None, "", " \t\n", "One", "one ", "A  b\tc", "a b c", "é" * 500, "x" * 900, "ab" * 400]
    for i in range(40):
        copy = list(base)
        for _ in range(i % 6):
            copy[random.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(n)) for n in (1, 3, 4, 5, 60, 90)]
    texts += texts[10:25] + [" ".join(base[:60]) + " tail of its own"]
    sources = ["b", "a", None, "é", ""]
    found = [(i, t, sources[i % 5] if i % 3 else "b", 7, "k", 1, "i") for i, t in enumerate(texts)]
    return [*found, found[12], (None, "no id at all", "b", 7, "k", 1, "i")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    plain = lambda t: SPACE.sub(" ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r[0])
    expected = []
    for r in rows:
        same = groups[plain(r[1])]
        least = min((i for i in same if i is not None), default=None)
        expected.append((r[0], least, len(same), r[0] == least, hashlib.sha256(plain(r[1]).encode()).hexdigest()))
    found = [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_bloom_filter_lets_every_repeat_through(spark):
    frame = spark.createDataFrame([(i, str(i // 2)) for i in range(6000)], "doc_id long, text string")
    assert exact_dedup.exact_dedup(frame).where("group_size = 2").count() == 6000


def test_suffix_dedup(docs, rows, empty):
    seen = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    expected = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.append(0, gone.astype(int))) == 1))
        expected.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    found = [tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_suffix_dedup_of_one_id_and_checksum(spark, doc_id):
    """Two texts with one id (or none) and one CRC-32 are two documents."""
    random.seed(6)
    letters = lambda n: bytes(random.choices(b"abcdefghij ", k=n))
    passage, seen_sums = letters(260), {}
    while True:  # about 80,000 draws
        text = letters(9) + passage + letters(9)
        other = seen_sums.setdefault(zlib.crc32(text), text)
        if other != text:
            break
    first, second = other, text
    texts = [first, second, passage]
    rows = [(doc_id, t.decode(), "s", 1, "k", 1, "i") for t in texts]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    seen = collections.Counter(t[1].encode()[p : p + 200] for t in rows for p in range(len(t[1].encode()) - 199))
    expected = []
    for t in rows:
        b, gone = t[1].encode(), set()
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone.update(range(p, p + 200))
        expected.append((len(b), len(gone)))
    assert sorted((r.n_bytes, r.n_removed) for r in found) == sorted(expected)


def test_suffix_dedup_of_a_passage_in_many_contexts(spark, monkeypatch):
    """One anchor's contexts never meet in one shard, and the result is that of brute force."""
    random.seed(11)
    passage = "".join(random.choice("abcdefgh ") for _ in range(230))
    texts = []
    for i in range(400):
        before = "".join(random.choice("xyz") for _ in range(random.choice([1, 2, 150])))
        texts.append(before + passage + "".join(random.choice("uvw") for _ in range(random.choice([0, 1, 150]))))
    texts += texts[:3]
    seen = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    expected = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        expected.append((i, int(gone.sum())))
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 5000)
    hashed = []
    plain = suffix_dedup._repeated_windows
    monkeypatch.setattr(suffix_dedup, "_repeated_windows", lambda w: hashed.append(w) or plain(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed").collect()
    assert sorted(tuple(r) for r in found) == expected
    heavy = hashed[0].groupBy("gram").agg({"context": "count"}).collect()
    assert len(heavy) > 0 and all(r[1] > 0 for r in heavy)


def test_suffix_dedup_broadcasts_no_anchors_or_windows(spark, confs, monkeypatch):
    """Files of anchors and windows are small beside what a broadcast of them holds."""
    confs(spark__sql__autoBroadcastJoinThreshold="10m")
    plans, plain = {}, suffix_dedup.stored

    def seen(df, name, **options):
        plans[name] = plan_of(df)
        return plain(df, name, **options)

    monkeypatch.setattr(suffix_dedup, "stored", seen)
    random.seed(12)
    text = "".join(random.choice("abcdefgh ") for _ in range(700))
    found = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    assert "SortMergeJoin [gram" in plans["shared"] and "BroadcastHashJoin" not in plans["shared"]
    assert "SortMergeJoin [gram" in plan_of(found) and "BroadcastHashJoin [gram" not in plan_of(found)
    assert found.where("n_removed = n_bytes").count() == 2


def test_suffix_dedup_can_split_a_hot_anchor(spark, monkeypatch):
    """The semi-join by anchor stands on plain reads: Spark does not split rows that are also counted there."""
    plans, plain = {}, suffix_dedup.stored

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name, **options)

    monkeypatch.setattr(suffix_dedup, "stored", seen)
    docs = spark.createDataFrame([(i, "the same text " * 30) for i in range(9)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).where("n_removed = n_bytes").count() == 9
    assert "Join LeftSemi" in plans["shared"] and "Aggregate" not in plans["shared"]


def _seeds(strings):
    text = np.frombuffer(b"".join(x + bytes([suffix_sort.END]) for x in strings), np.uint8)
    padded = np.concatenate((text, np.full(suffix_sort.LIMIT + 8, suffix_sort.PAD, np.uint8)))
    return text.tobytes(), suffix_sort.seeds(padded, suffix_sort.suffix_types(text))


def test_seeds_are_sorted_once(monkeypatch):
    """Suffixes that tie with one other are compared with it, and not sorted round after round."""
    draw = np.random.default_rng(3)
    strings = [draw.integers(1, 200, 250, dtype=np.uint8).tobytes() for _ in range(40)]
    sizes, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **options: sizes.append(len(a)) or plain(a, *args, **options))
    _, (order, _) = _seeds(strings * 2)
    assert sum(sizes) <= 1.1 * len(order)


@pytest.mark.parametrize("limit", [3, 8, 9, 17, 200])
def test_seeds_in_order_with_common_prefixes(monkeypatch, limit):
    monkeypatch.setattr(suffix_sort, "LIMIT", limit)
    draw = random.Random(limit)
    for letters in (b"ab", b"abc\xc3\xa9", b"\x00\x01"):
        strings = [bytes(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(60)]
        text, (order, shared) = _seeds([*strings, *strings[:20], b"a" * 30, b"ab" * 15, strings[0]])
        tails = [text[p : p + limit] for p in order.tolist()]
        small = suffix_sort.suffix_types(np.frombuffer(text, np.uint8))
        assert sorted(order.tolist()) == [p for p in range(1, len(text)) if small[p] and not small[p - 1]]
        for x, y, n in zip(tails[:-1], tails[1:], shared[1:].tolist(), strict=True):
            assert n == len(os.path.commonprefix([x, y]))
            # behind the end of the text a NUL may stand on either side
            assert x <= y or x.rstrip(b"\x00") == y


@pytest.mark.parametrize("at_once", [1, 5, 40])
def test_seeds_sorted_in_parts(monkeypatch, at_once):
    """However few are sorted together, order and common prefixes are the same, also where parts meet."""
    draw = random.Random(at_once)
    for letters in (b"ab", b"abc\xc3\xa9", b"\x00\x01", bytes(range(250))):
        strings = [bytes(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(60)]
        strings += [*strings[:20], b"a" * 30, b"ab" * 15, strings[0]]
        monkeypatch.setattr(suffix_sort, "SEEDS_AT_ONCE", 1 << 18, raising=False)
        text, (order, shared) = _seeds(strings)
        monkeypatch.setattr(suffix_sort, "SEEDS_AT_ONCE", at_once)
        _, (parted, parted_shared) = _seeds(strings)
        tails = [text[p : p + suffix_sort.LIMIT] for p in parted.tolist()]
        assert sorted(parted.tolist()) == sorted(order.tolist())
        assert tails == [text[p : p + suffix_sort.LIMIT] for p in order.tolist()]
        assert parted_shared.tolist() == shared.tolist()
        for x, y, n in zip(tails[:-1], tails[1:], parted_shared[1:].tolist(), strict=True):
            assert n == len(os.path.commonprefix([x, y]))


def test_packed_texts_leave_in_small_batches():
    """A batch of many bytes is not held packed as a whole; every text is in it, null as empty."""
    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdefgh ", k=50_000)) for _ in range(120)] + [None, "", "é"]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([b"m"] * len(texts)), pa.array(texts)]
    made = list(suffix_dedup._packed(iter([pa.RecordBatch.from_arrays(columns, ["id", "mark", "text"])])))
    unpack = zstandard.ZstdDecompressor()
    found = [(x["id"], unpack.decompress(x["packed"]).decode()) for batch in made for x in batch.to_pylist()]
    assert found == [(i, t or "") for i, t in enumerate(texts)]
    assert len(made) > 1


def test_spans_of_texts_merge_into_runs():
    draw = random.Random(9)
    spans = [[(a, a + draw.randint(1, 9)) for a in draw.choices(range(60), k=draw.randint(0, 12))] for _ in range(80)]
    spans[0], spans[7], spans[-1] = [], [(0, 5), (5, 9)], []
    starts = np.cumsum([0, *map(len, spans)])
    flat = np.array([s for each in spans for s in each], np.int64)
    begins, first, end = suffix_dedup._merged(starts, flat[:, 0], flat[:, 1])
    for i, each in enumerate(spans):
        gone = "".join("x" if any(a <= p < b for a, b in each) else " " for p in range(70))
        own = slice(begins[i], begins[i + 1])
        assert list(zip(first[own].tolist(), end[own].tolist())) == [m.span() for m in re.finditer("x+", gone)]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in suffix_dedup._merged(np.zeros(4, np.int64), none, none)] == [4, 0, 0]


def test_memory_of_a_sorted_shard(tmp_path):
    """Sorting a shard takes less than 18 bytes for each of its bytes, the text not counted (33 before)."""
    draw = np.random.default_rng(5)
    body = draw.choice(np.frombuffer(b"    eeeetttaaaooinshrdlu", np.uint8), 4_000_000)
    body[299::300] = suffix_sort.END
    padded = np.append(body, np.full(suffix_sort.LIMIT + 8, suffix_sort.PAD, np.uint8))
    tracemalloc.start()
    try:
        suffix_sort.repeated_starts(padded, suffix_sort.Scratch(str(tmp_path)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 18 * len(body)


def test_suffix_sort_on_disk(monkeypatch):
    for trial in range(150):
        random.seed(trial)
        monkeypatch.setattr(suffix_sort, "LIMIT", random.choice([3, 5, 9, 17]))
        monkeypatch.setattr(suffix_sort, "QUEUE_TUPLES", random.choice([10, 1 << 20]))
        monkeypatch.setattr(suffix_sort, "IN_MEMORY", random.choice([50, 1 << 20]))
        letters = random.choice([b"ab", b"abc", b"a", bytes(range(250))])
        strings = [bytes(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(8)]
        strings += [strings[0], strings[1][3:]]
        size = suffix_sort.LIMIT
        where = collections.defaultdict(list)
        body = b""
        for s in strings:
            for i in range(len(s) - size + 1):
                where[s[i : i + size]].append(len(body) + i)
            body += s + bytes([suffix_sort.END])
        padded = np.frombuffer(body + bytes([suffix_sort.PAD]) * (size + 8), np.uint8)
        with tempfile.TemporaryDirectory() as folder:
            marked = suffix_sort.repeated_starts(padded, suffix_sort.Scratch(folder))
        for places in where.values():
            assert marked[places].tolist() == [len(places) > 1] * len(places)


def near_brute(rows, k, percent):
    sets = {}
    for r in rows:
        w = [x for x in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) if x]
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [i for i in sets if i is not None]
    for i in known:
        for j in known:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, empty, k):
    expected = near_brute(rows, k, 80)
    found = near_dedup.near_duplicates(docs, k=k).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    """Copies and near copies of both texts are linked, whichever text is read first; null ids are not."""
    random.seed(2)
    text = lambda: [f"w{random.randrange(10**6)}" for _ in range(60)]
    for trial in range(3):
        a, b, c, d, e = text(), text(), text(), text(), text()
        near = lambda t: " ".join([*t, "more"])
        rows = [
            (7, " ".join(a)), (7, " ".join(b)), (30, " ".join(b)), (20, near(b)), (40, " ".join(a)), (10, near(a)),
            (5, " ".join(c)), (6, " ".join(d)), (None, near(d)), (8, near(d)), (9, " ".join(e)), (9, ""), (7, " ".join(b)),
        ]
        random.shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = near_dedup.near_duplicates(frame).collect()
        assert len(found) == len(rows)
        expected = {7: 7, 30: 7, 20: 7, 40: 7, 10: 7, 5: 5, 6: 6, 8: 6, 9: 9, None: None}
        assert all(r.component_id == expected[r.doc_id] for r in found)


def test_contained_items(spark, docs, rows, empty):
    items = [(1, rows[11][1]), (2, " ".join(rows[11][1].split()[20:50]).upper() + "!"), (3, None), (4, "zz yy"), (4, "one"), (2, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contained_items(docs, bench).collect()

    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())

    expected = set()
    for r in rows:
        for item, text in items:
            if grams(text) and len(grams(text) & grams(r[1])) >= math.ceil(len(grams(text)) * 0.8 - 1e-9):
                expected.add((r[0], item))
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in expected}
    assert decontaminate.contained_items(empty, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_short_items_inside_longer_documents(spark):
    texts = {1: "a b c d e f g", 2: "B, c", 3: "x b c", 4: "c b", 5: "p q r s t", 6: "q", 7: "a bc d", 8: None}
    items = {10: "b c", 11: "Q!", 12: "c d e f", 13: "q r s", 14: "zz", 15: "a b c d e f"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()}
    assert found == {(1, 10), (2, 10), (3, 10), (5, 11), (6, 11), (1, 12), (5, 13), (1, 15)}


def test_sharding(docs, rows, empty):
    found = sharding.shard_documents(docs, 4).collect()
    assert len(found) == len(rows)
    shard_of = {}
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty, 4).count() == 0


def test_schedule_is_longest_processing_time():
    for trial in range(200):
        random.seed(trial)
        sizes = sorted((random.choice([1, 2, 3, 5, 40, 100]) for _ in range(random.randint(0, 90))), reverse=True)
        loads, expected = [0, 0, 0], collections.Counter()
        for size in sizes:
            i = min(range(3), key=lambda s: (loads[s], s))
            loads[i] += size
            expected[size, i] += 1
        runs = sorted(collections.Counter(sizes).items(), reverse=True)
        totals = [0, 0, 0]
        for size, shard, first, last in sharding.schedule(runs, 3):
            totals[shard] += size * (last - first + 1)
        assert sorted(totals) == sorted(loads)


def test_mixing(spark, docs, rows, empty):
    quality = mixing.quality_weights(spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, None, 0), (None, 1, 0)], LABELS))
    found = mixing.mix(docs, quality).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len([w for w in SPACE.split(r[1] or "") if w])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if shares[s] > 3 * sizes[s]}
        if not above:
            target |= shares
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.times * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in order)
    again = mixing.mix(docs.repartition(2), quality).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(empty, quality).count() == 0


def test_toxicity_on_held_out_documents(spark, empty):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5)))
    texts, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(random.randint(20, 60))]
        toxic = i % 8 == 0
        if toxic:
            words[random.randrange(len(words))] = random.choice(["grumbleworm", "snotling"])
            words[random.randrange(len(words))] = "grumbleworms"
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    texts += [(5000, None), (5001, ""), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5000, 1, 0), (None, 1, 1), (7, 1, None)], LABELS)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert len(found) == len(texts)
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    right = sum(found[i].predicted == labels[i][2] for i in held)
    assert right / len(held) > 0.97
    assert found[5000].score == found[5001].score < 0.5
    assert toxicity.toxicity(empty, known.limit(0)).count() == 0
