"""Operators on documents against plain versions, with the odd cases of every table."""

import hashlib
import pickle
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import cdc, gif, linededup, mixing, packing, quality, simhash, toxicity
from sightline.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


# -- line dedup


def plain_line_dedup(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and d is not None:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_keys", "probes"), [(linededup.SHARD_KEYS, linededup.PROBES), (1, 2)])
def test_line_dedup(make_docs, odd_rows, shard_keys, probes):
    shared = "This line is shared by several documents"
    rows = odd_rows + [(k, f"own {k}\n  {shared.upper() if k % 2 else shared}\r\n{'é' * 20}\n{'é' * 19}\nend") for k in range(20, 26)] + [(None, shared), (30, shared + "\n" + shared)]
    got = linededup.shared_lines(make_docs(rows), shard_keys=shard_keys, probes=probes)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_line_dedup(rows)


def test_line_dedup_keeps_columns(make_docs):
    shared = "This line is shared by several documents"
    docs = make_docs([(k, f"{shared}\nown {k}") for k in range(4)] + [(9, None)])
    out = linededup.without_shared_lines(docs)
    assert out.schema == docs.schema
    by = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert by[0] == ("own 0", 5) and by[3][0].startswith(shared) and by[9] == (None, None)


def test_line_dedup_empty(make_docs):
    assert linededup.shared_lines(make_docs([])).collect() == []
    assert linededup.without_shared_lines(make_docs([])).collect() == []


def test_line_dedup_probes_arrays(make_docs):
    """Lines meet the index as a stream past a shard's arrays: no join has their hashes as keys."""
    found = linededup.shared_keys(make_docs([(k, "This line is shared by several documents\nand one is not, of document %d" % k) for k in range(5)]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ("h1" in line or "h2" in line)]
    assert {r.doc_id: len(r.gone) for r in found.collect()} == {0: 1, 1: 1, 2: 1, 3: 1}


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal(keys):
    array = np.array(sorted(keys), dtype=np.uint64)
    h = linededup.PerfectHash(array)
    assert sorted(h(array).tolist()) == list(range(len(array)))


def test_shard_with_colliding_halves():
    h1, h2 = np.array([5, 5, 9]), np.array([1, 2, 1])
    shard = linededup.Shard(h1, h2, np.array([3, 400, 2]), np.array([30, 40, 50]))
    ok, keeper = shard.probe(np.array([5, 5, 9, 9, 7]), np.array([2, 1, 1, 2, 1]))
    assert ok.tolist() == [True, True, False, False, False] and keeper[:2].tolist() == [40, 30]


# -- SimHash


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    label = list(range(len(prints)))
    for _ in label:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("task", [simhash.TASK, 16])
def test_simhash(make_docs, odd_rows, task):
    base = " ".join(f"token{k}" for k in range(300))
    rows = odd_rows + [(100 + k, base.replace(f"token{50 + 7 * k}", f"other{k}")) for k in range(25)] + [(90, base.upper()), (91, "two words")]
    prints = [plain_print(t) for _, t in rows]
    labels = plain_components(prints)
    smallest = {}
    for (d, _), c in zip(rows, labels, strict=True):
        if d is not None:
            smallest[c] = min(smallest.get(c, d), d)
    want = sorted([(d, p, smallest.get(c)) for (d, _), p, c in zip(rows, prints, labels, strict=True)], key=str)
    got = simhash.near_copies(make_docs(rows), task)
    assert sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got.collect()], key=str) == want


def test_sketches_tell_similarity():
    """Sketches of texts with known similarity of five-word shingles, and what the stage keeps of near copies."""
    draw = np.random.default_rng(3)
    for n, edits in ((2000, 20), (400, 4), (300, 60)):
        words = [f"w{x}" for x in draw.integers(0, 5000, n)]
        other = list(words)
        for k in draw.permutation(n)[:edits]:
            other[k] = "edited"
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        a, b = (simhash.sketch(simhash.shingle_hashes(simhash.word_hashes(" ".join(w).encode()), 5)).view(np.uint64) for w in (words, other))
        told = 1 - 2 * int(np.bitwise_count(a ^ b).sum()) / simhash.SKETCH_BITS
        assert abs(told - true) < 0.25


def test_stage_links_near_copies_only(make_docs):
    draw = np.random.default_rng(5)
    texts = [[f"w{x}" for x in draw.integers(0, 3000, 300)] for _ in range(12)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rows += [(100 + k, " ".join([*t[:150], "changed", *t[151:]])) for k, t in enumerate(texts)]  # similarity 0.97
    rows += [(200 + k, " ".join(["other" if j % 6 == 0 else w for j, w in enumerate(t)])) for k, t in enumerate(texts)]  # far below 0.8
    got = {r.doc_id for r in simhash.representatives(make_docs(rows)).collect()}
    assert got >= {*range(12), *range(200, 212)} and len(got & set(range(100, 112))) <= 1


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 63)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_trie_walk(seeds, flips):
    codes = set(seeds)
    for k, bit in flips:
        codes.add(seeds[k % len(seeds)] ^ (1 << bit))
    c = np.array(sorted(codes), dtype=np.uint64)
    z = np.zeros(1, np.int64)
    found = {(int(i), int(j)) for a, b in simhash.walk((z, z + len(c)), (z, z + len(c)), c, z, 0) for i, j in zip(a, b, strict=True)}
    assert found == {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if (int(c[i]) ^ int(c[j])).bit_count() <= 2}


def test_bands_keep_all_bits():
    x = np.array([0x0123456789ABCDEF, 2**63, 1], dtype=np.uint64)
    for _, order in simhash.orders(2) + simhash.orders(6):
        y = simhash.arranged(x, order)
        assert np.bitwise_count(y).tolist() == np.bitwise_count(x).tolist()
        assert np.bitwise_count(y[0] ^ y[1]) == np.bitwise_count(x[0] ^ x[1])


def test_representatives(make_docs):
    docs = make_docs([(3, "same words here"), (1, "Same words HERE"), (3, "same words here"), (8, "quite another text"), (None, "lone text stays here"), (None, "lone text stays here")])
    out = simhash.representatives(docs)
    assert out.schema == docs.schema
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == [(1, "Same words HERE"), (8, "quite another text"), (None, "lone text stays here")]
    assert simhash.representatives(make_docs([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (100, 100)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}


@pytest.mark.parametrize("n", [3000])
def test_components_of_shuffled_chains(spark, n):
    """Labels in random order along a chain, signed as fingerprints are: rounds must not grow with its length."""
    draw = np.random.default_rng(7)
    names = (draw.permutation(4 * n)[: 2 * n] - 2 * n).tolist()
    one, two = names[:n], names[n:]
    links = spark.createDataFrame([(a, b) for x in (one, two) for a, b in zip(x, x[1:])], "a long, b long")  # noqa: B905
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {k: min(one) for k in one} | {k: min(two) for k in two}


# -- mixing


def test_word_count(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = docs.select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.text or "")) for r in got)


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] for s in full} | share
        full |= over


def test_mixing(make_docs):
    rows = [(k, "w " * (k % 97), f"s{k % 7}" if k % 11 else None) for k in range(900)] + [(5, "same row", "s1")] * 3 + [(None, None, "empty"), (7000, "w " * 9000, "s3")]
    docs = make_docs(rows)
    got = mixing.mix(docs, shard_words=4000).collect()
    again = mixing.mix(docs.repartition(5), shard_words=4000).collect()
    key = lambda r: str((r.doc_id, r.source, r.text_hash, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.passes * r.size + sum(x["to"] - x["from"] for x in r.ranges)
    want = plain_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 64 for s in sizes)


def test_apportion_is_sainte_lague(spark):
    votes = {f"p{k}": v for k, v in enumerate([53000, 24000, 23000, 900, 10, 7, 7])}
    df = spark.createDataFrame([(k, float(v), 37, 1000, 0) for k, v in votes.items()], "k string, _votes double, _seats long, _most long, g int")
    got = {r.k: r.quota for r in mixing.apportion(df, ["g"], ["k"]).collect()}
    won = dict.fromkeys(votes, 0)
    for _ in range(37):
        won[min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))] += 1
    assert got == won


def test_mixed_texts(make_docs):
    docs = make_docs([(k, f"alpha{k}  beta\tgamma\n" * 40, "ab"[k % 2]) for k in range(12)] + [(50, None, "a"), (51, "", "b")])
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = mixing.mixed_texts(docs)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        assert len(WORD.findall(r.text)) == plan[r.doc_id].taken and r.n_chars == len(r.text)
        whole = f"alpha{r.doc_id}  beta\tgamma\n" * 40
        spaced = re.findall(r"[^ \t-\r]+[ \t-\r]*", whole)
        told = plan[r.doc_id]
        assert r.text == "\n".join([whole] * told.passes + ["".join(spaced[a:b]).rstrip(" ") for a, b in told.ranges])
    assert any(len(r.ranges) for r in plan.values())
    assert {r.doc_id for r in out.collect()} == {d for d, r in plan.items() if r.taken}
    assert mixing.mix(make_docs([])).collect() == []


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check_packing(rows, pieces, tokenizer, length):
    def ids(text):
        return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")

    # Rows that share an id are told apart by length; equal ones are interchangeable.
    left = defaultdict(list)
    for p in pieces:
        left[p.doc_id, p.doc_tokens].append(p)
    whole = defaultdict(list)
    for d, t in rows:
        whole[d, len(ids(t))].append(ids(t))
    assert set(left) == set(whole)
    for k, texts in whole.items():
        if len(texts) == 1:
            at = 0
            for p in sorted(left[k], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(texts[0][at : at + p.length].tobytes())
                at += p.length
            assert at == k[1]
        else:
            assert sum(p.length for p in left[k]) == k[1] * len(texts)
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return sum(p.length for p in pieces) / (length * len(windows))


@pytest.mark.parametrize("merge", [packing.MERGE, 4])
def test_packing(make_docs, odd_rows, tokenizer, merge):
    rows = odd_rows + [(100 + k, " ".join(f"item{k} thing{j}" for j in range((k * 37) % 90))) for k in range(150)]
    out = packing.pack(make_docs(rows).repartition(5), length=256, most=6, merge=merge)
    assert out.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert check_packing(rows, out.collect(), tokenizer, 256) > (0.97 if merge > 4 else 0.8)
    assert packing.pack(make_docs([])).collect() == []


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_tokens_are_the_tokenizers(text):
    tokens = packing.tokens_for(public_tokenizers.path(packing.TOKENIZER))
    assert tokens(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


# -- content-defined chunks


def plain_repeats(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = {}, []
    for k in order:
        d, t = rows[k]
        begin, end, words, digests = cdc.chunks((t or "").encode())
        run = None
        for i in range(len(begin) + 1):
            if i < len(begin) and digests[i] in seen:
                run = run or [begin[i], 0, 0, seen[digests[i]]]
                run[1], run[2] = end[i] - run[0], run[2] + words[i]
            else:
                if run and run[2] >= cdc.PASSAGE_WORDS:
                    out.append((d, *run))
                run = None
            if i < len(begin):
                seen.setdefault(digests[i], d)
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_hits", [2, cdc.HOT_HITS])
def test_chunking(make_docs, odd_rows, hot_hits):
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = odd_rows + [(20 + k, f"start {k} of words alone {passage} and own{k} words at end") for k in range(6)] + [(40, "\n".join(passage.split()))]
    docs = make_docs(rows)
    got = cdc.repeats(docs, hot_hits=hot_hits).select("doc_id", "begin", "n_bytes", "n_words", "first_doc_id").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_repeats(rows)
    assert {r.doc_id for r in got} >= {21, 22, 23, 24, 25, 40}
    out = cdc.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    by = {r.doc_id: r.text for r in out.collect()}
    assert passage in by[20] and "shared30" not in by[24] and by[24].startswith("start 4") and by[1] is None
    assert cdc.repeats(make_docs([])).collect() == []


def test_every_keeper_of_a_run_is_named(make_docs):
    """Repeated passages that follow each other directly: one run, and each passage's keeper with its stretch."""
    parts = {k: " ".join(f"part{k}word{j}" for j in range(70)) for k in (1, 2, 3)}
    # Ends where a chunk ends by its hash, so that no chunk reaches into the next passage.
    parts = {k: t[: cdc.chunks(t.encode())[1][-2]] for k, t in parts.items()}
    rows = [(k, parts[k]) for k in (1, 2, 3)] + [(10, " ".join(parts[k] for k in (3, 1, 2))), (None, parts[1])]
    got = {r.doc_id: r for r in cdc.repeats(make_docs(rows)).collect()}
    for d, owners in ((10, [3, 1, 2]), (None, [1])):
        spans, t = got[d].keepers, dict(rows)[d]
        assert [t[s.begin : s.begin + s.n_bytes] for s in spans] == [parts[k] for k in owners] and [s.first_doc_id for s in spans] == owners
        assert sum(s.n_words for s in spans) == got[d].n_words and (got[d].begin, got[d].n_bytes, got[d].first_doc_id) == (0, len(t), owners[0])


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_chunks_cover_all_words(data):
    begin, end, words, _ = cdc.chunks(data)
    assert sum(words) == len(data.split())
    assert b" ".join(data[a:b] for a, b in zip(begin, end, strict=True)).split() == data.split()


def test_chunks_resist_shifts():
    body = " ".join(f"w{k * 7919 % 5000}" for k in range(400))
    one, two = (set(cdc.chunks(x.encode())[3]) for x in (body, "a few new words in front " + body))
    assert len(one & two) > 0.9 * len(one)


# -- GIF


def plain_lzw_decode(data, size):
    """Bit by bit, as the format's description has it."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, end = 1 << size, (1 << size) + 1
    table, width, at, out, last = {}, size + 1, 0, [], None
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = {k: [k] for k in range(clear)} | {clear: [], end: []}, size + 1, None
        elif code == end:
            return bytes(out), True
        else:
            piece = table[code] if code in table else [*last, last[0]]
            out += piece
            if last is not None and len(table) < 4096:
                table[len(table)] = [*last, piece[0]]
                width = max(width, min(12, len(table).bit_length()))
            last = piece
    return bytes(out), False


@given(st.binary(min_size=1, max_size=700) | st.lists(st.sampled_from(b"ab "), min_size=1, max_size=3000).map(bytes))
@settings(max_examples=60, deadline=None)
def test_lzw_round_trip(data):
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8, len(data)).tobytes() == data
    assert plain_lzw_decode(stream, 8) == (data, True)


def test_lzw_full_table():
    data = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    few = (data % 4).astype(np.uint8)
    for samples, size in ((data, 8), (few, 2), (few, 8)):
        stream = gif.lzw_encode(samples.tobytes(), size)
        assert (gif.lzw_decode(stream, size, len(samples)) == samples).all()
        assert plain_lzw_decode(stream, size) == (samples.tobytes(), True)


def test_lzw_deferred_clear():
    """A stream that goes on with a full table instead of clearing it."""
    data = np.random.default_rng(2).integers(0, 256, 9_000)
    codes = np.array([256, *data.tolist(), 257])
    stream = gif._packed_bits(codes, np.concatenate(([9], gif._widths(len(data) + 1, 8, 258))))
    assert plain_lzw_decode(stream, 8) == (data.astype(np.uint8).tobytes(), True)
    assert gif.lzw_decode(stream, 8, len(data)).tobytes() == data.astype(np.uint8).tobytes()


def test_gif_disposal_transparency_and_interlace():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], dtype=np.uint8)
    pic = lambda value, h, w, **k: gif.picture(np.full((h, w), value), stream=gif.lzw_encode(bytes([value]) * (h * w)), **k)
    rows = np.arange(16).reshape(16, 1) % 4
    order = np.concatenate([np.arange(a, 16, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    data = gif.file_of(4, 16, [
        pic(1, 16, 4, delay_cs=5), pic(2, 2, 2, at=(1, 1), disposal=3, delay_cs=7), pic(3, 2, 2, disposal=2), pic(3, 16, 4, transparent=3),
        gif.picture(np.repeat(rows, 4, axis=1), interlaced=True, stream=gif.lzw_encode(np.repeat(rows, 4, axis=1)[order].astype(np.uint8).tobytes())),
    ], palette)
    frames = list(gif.decode(data))
    assert [f.delay_ms for f in frames] == [50, 70, 40, 40, 40]
    red, green, blue = ([int(v) for v in palette[k]] + [255] for k in (1, 2, 3))
    assert frames[0].canvas[1, 1].tolist() != green and frames[1].canvas[1, 1].tolist() == green and frames[1].canvas[0, 0].tolist() == red
    assert frames[2].canvas[2, 2].tolist() == red and frames[2].canvas[0, 0].tolist() == blue  # the square is undone
    assert frames[3].canvas[0, 0].tolist() == [0, 0, 0, 0] and frames[3].canvas[5, 3].tolist() == red  # cleared, then seen through
    assert (frames[4].samples[:, 0] == rows[:, 0]).all()
    for broken in (data[:-30], b"GIF00a", b"", data[:9]):
        with pytest.raises(ValueError):
            list(gif.decode(broken))


def plain_features(text):
    """Every column of the query, from the text and a plain reading of the stored bytes."""
    body = (text or "").encode()
    payload = body + b"\xff" * ((-len(body)) % 576 if body else 576)
    media = gif.store(payload)
    at, samples, n = 13 + 768, b"", 0
    while media[at] != 0x3B:
        assert media[at : at + 3] == b"\x21\xf9\x04" and media[at + 6] == 255 and media[at + 3] == (1 + n % 3) << 2 | 1
        w, h = int.from_bytes(media[at + 13 : at + 15], "little"), int.from_bytes(media[at + 15 : at + 17], "little")
        laced, stream, at = media[at + 17] & 0x40, b"", at + 19
        while media[at]:
            stream, at = stream + media[at + 1 : at + 1 + media[at]], at + 1 + media[at]
        at += 1
        rows = plain_lzw_decode(stream, 8)[0]
        if laced:
            sent, straight = iter(range(h)), [b""] * h
            for r in [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]:
                k = next(sent)
                straight[r] = rows[k * w : (k + 1) * w]
            rows = b"".join(straight)
        samples, n = samples + rows, n + 1
    assert samples == payload
    return payload, media, n


def test_gif_query(make_docs, odd_rows, spark):
    docs = make_docs([*odd_rows, (8, "a short text")])
    out = gif.features(gif.stored(docs)).collect()
    assert len(out) == len(odd_rows) + 1
    want = {}
    for d, t in [*odd_rows, (8, "a short text")]:
        payload, media, n = plain_features(t)
        want[d, hashlib.sha256(payload).hexdigest()] = (len((t or "").encode()), len(payload), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), n)
    for r in out:
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == want[r.doc_id, r.payload_sha256][:5]
        # Two of three frames leave their picture behind, which later ones may cover; one text's single frame shows its bytes.
        n = want[r.doc_id, r.payload_sha256][5]
        assert r.feature.startswith(f"frames={n};ms={40 * n};")
        shown = [sum(map(int, part[2:].split(","))) for part in r.feature.split(";")[2:]]
        assert len(set(shown)) == 1 and (n > 1 or shown[0] == r.n_bytes)
    alike = {(r.payload_sha256, r.media_sha256, r.feature) for r in out if r.doc_id in (4, 7, 8)}
    assert len(alike) == 1
    long_one = next(r for r in out if r.doc_id == 5)
    assert long_one.media_bytes < 0.6 * long_one.payload_bytes
    rows = gif.frames(gif.stored(make_docs([(1, "x" * 2000), (2, None)]))).collect()
    assert {r.doc_id: sum(r.histogram) for r in rows} == {1: 2000, 2: 0}
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no gif"))], "doc_id long, media binary")
    assert gif.frames(bad).collect() == []
    told = {r.doc_id: r for r in gif.features(bad.withColumn("n_bytes", F.lit(5).cast("long"))).collect()}
    assert told[1].media_bytes is None and told[2].media_bytes == 6 and told[2].payload_sha256 is None
    assert gif.features(gif.stored(make_docs([]))).collect() == []


# -- classifiers


def test_quality_learns(make_docs, spark, odd_rows):
    good = [(k, " ".join(f"Plain words number {j} make a sentence." for j in range(5 + k % 9))) for k in range(100, 220)]
    bad = [(k, " ".join(f"JUNK{j}!! CLICK$$$ now***" for j in range(5 + k % 9))) for k in range(300, 380)]
    docs = make_docs(good + bad + odd_rows)
    labels = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(None, 1), (5, None), (100, 1)], "doc_id long, quality int")
    out = quality.scored(docs, quality.train(docs, labels)).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id >= 100]
    assert held and all((r.predicted == 1) == (r.doc_id < 300) for r in held) and all(0 <= r.score <= 1 for r in out)
    assert len(out) == len(good + bad + odd_rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} >= {d for d, _ in good}


def test_quality_without_labels(make_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "x"), (2, None)])
    assert [r.score for r in quality.scored(docs, quality.train(docs, labels)).collect()] == [0.5, 0.5]
    assert quality.scored(make_docs([]), quality.fit([])).collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(60, 4)), np.where(draw.random(60) > 0.5, 1.0, -1.0)
    x[:, 0] += y
    at = np.arange(4)
    w = quality.dual_coordinate_descent([at] * 60, list(x), y, 4, np.full(60, 0.5), epochs=500)
    full = np.hstack([x, np.ones((60, 1))])
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (full @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in draw.normal(scale=0.02, size=(200, 5)))


def test_toxicity_learns_and_is_fair(make_docs, spark):
    known = toxicity.kinds()
    calm, rude = "The boat left the harbour.", "What an awful nastyword you are."
    rows = [(k, calm + f" Word{k % 17} follows.", 0) for k in range(300)] + [(1000 + k, f"The women met. {rude} Word{k % 17}.", 1) for k in range(80)] + [(2000 + k, f"The men met. {calm}", 0) for k in range(60)]
    data = [(toxicity.features(toxicity.words_of(t.encode()), known), y) for _, t, y in rows]
    pairs = [p for _, t, _ in rows for p in toxicity.swaps(t.encode(), known)]
    free, fair = toxicity.fit(data, pairs, fairness=0.0), toxicity.fit(data, pairs)
    gap = lambda m: abs(toxicity.score(m, b"The women met.", known) - toxicity.score(m, b"The men met.", known))
    assert gap(fair) < 0.05 < gap(free)
    docs = make_docs([(d, t) for d, t, _ in rows] + [(None, None), (9999, "")])
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in out if r.held_out and r.doc_id != 9999]
    truth = {d: y for d, _, y in rows}
    assert held and all(r.predicted == truth[r.doc_id] for r in held) and len(out) == len(rows) + 2
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_penalty_acts_without_names(make_docs, spark):
    """Where no text names a group, names are put in: the fit differs with the penalty off, and names stay neutral."""
    rows = [(k, " ".join(f"word{(k * 7 + j) % 40} stone." for j in range(8)) + (" awful nastyword." if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    known = toxicity.kinds()
    told = [(toxicity.prepared(t.encode(), known), y) for _, t, y in rows]
    pairs = [p for (_, ps), _ in told for p in ps]
    docs = [(found, y) for (found, _), y in told]
    assert len(pairs) > 200
    free, fair = toxicity.fit(docs, pairs, 0.0), toxicity.fit(docs, pairs)
    change = lambda m: float(np.sqrt(np.mean([(sum(m["weights"].get(g, 0) for g in a) - sum(m["weights"].get(g, 0) for g in b)) ** 2 for a, b in pairs])))
    assert change(fair) < 0.05 * change(free) and free["weights"] != fair["weights"]
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    trained = [toxicity.train(make_docs([r[:2] for r in rows]), labels, fairness=f) for f in (0.0, toxicity.FAIRNESS)]
    assert trained[0]["weights"] != trained[1]["weights"]
    assert toxicity.scored(make_docs([]), fair).collect() == []


def test_every_name_of_a_kind_is_tried():
    known = toxicity.kinds()
    pairs = toxicity.swaps(b"Some muslims came. Nobody else.", known)
    assert len(pairs) == len(known[b"muslims"]) - 1 and {n for g, _ in pairs for n in g if b" " not in n} == set(known[b"muslims"]) - {b"muslims"}
    assert all(len(set(k)) == len(k) for k in toxicity.IDENTITIES) and len(known) == sum(map(len, toxicity.IDENTITIES))


def test_toxicity_reaches_the_optimum():
    """The fitted loss against plain gradient descent with a small step."""
    known = toxicity.kinds()
    rows = [(f"the {('boat', 'ship', 'raft')[k % 3]} of {('women', 'men')[k % 2]} {'nasty' if k % 4 == 0 else 'calm'} day{k % 5}.", int(k % 4 == 0)) for k in range(60)]
    told = [(toxicity.prepared(t.encode(), known), y) for t, y in rows]
    docs, pairs = [(f, y) for (f, _), y in told], [p for (_, ps), _ in told for p in ps]
    model = toxicity.fit(docs, pairs, rounds=4000)
    names = sorted(model["weights"])
    x = np.array([[float(g in f) for g in names] for f, _ in docs])
    y = np.array([float(v) for _, v in docs])
    d = np.array([[float(g in a) - float(g in b) for g in names] for a, b in pairs])

    def loss(w, b):
        m = x @ w + b
        return np.mean(np.logaddexp(0, m) - y * m) + toxicity.L2 * w @ w / 2 + toxicity.FAIRNESS * np.mean((d @ w) ** 2)

    w, b = np.zeros(len(names)), 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.05 * (x.T @ p / len(y) + toxicity.L2 * w + 2 * toxicity.FAIRNESS * d.T @ (d @ w) / len(d)), b - 0.05 * p.mean()
    assert loss(np.array([model["weights"][g] for g in names]), model["bias"]) <= loss(w, b) + 1e-3


def plain_quality(docs, text):
    """The score of a text by a dense model: n-grams by hand, ratios, a hinge loss by subgradients, no sharing of code but the curve's fit."""
    def shape(word):
        out = []
        for ch in word:
            c = "a" if ord(ch) >= 0x80 or ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch
            if len(out) < 2 or out[-1] != c or out[-2] != c:
                out.append(c)
        return "".join(out)

    def grams(t):
        words, shapes = t.lower().split(), [shape(w) for w in t.split()]
        found = {("w", w) for w in words} | {("b", *ab) for ab in zip(words, words[1:])}  # noqa: B905
        for seq, name in ((shapes, "s"), (list(zip(shapes, shapes[1:])), "p")):  # noqa: B905
            for g in set(seq):
                level = sum(seq.count(g) / len(words) > s for s in quality.SHARES)
                found |= {(name, g, k) for k in range(level)}
        return found

    rows = [(grams(t), 1 if y else -1) for t, y in docs]
    counts = defaultdict(int)
    for g, _ in rows:
        for x in g:
            counts[x] += 1
    names = sorted((x for x, c in counts.items() if c >= quality.LEAST_DOCS), key=repr)
    f = np.array([[float(x in g) for x in names] for g, _ in rows])
    y = np.array([s for _, s in rows])
    p, q = f[y > 0].sum(axis=0) + 1, f[y < 0].sum(axis=0) + 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    scale = lambda v: v * r / max(np.linalg.norm(v * r), 1e-9)
    x = np.hstack([np.array([scale(v) for v in f]), np.ones((len(f), 1))])
    cost = np.where(y > 0, quality.COST * len(y) / (2 * (y > 0).sum()), quality.COST * len(y) / (2 * (y < 0).sum()))
    w = np.zeros(x.shape[1])
    for k in range(1, 60_000):
        w -= (1.0 / (k + 50)) * (w - (cost * y * (y * (x @ w) < 1)) @ x)
    one = np.append(scale(np.array([float(n in grams(text)) for n in names])), 1.0)
    return float(one @ w)


def test_quality_margins_against_a_plain_model():
    docs = [(" ".join(f"Plain words number {j} make a sentence." for j in range(3 + k % 4)), 1) for k in range(14)] + [(" ".join(f"JUNK{j}!! CLICK$$$ now***" for j in range(3 + k % 4)), 0) for k in range(9)]
    docs += [("Plain words CLICK$$$ now***", 1), ("JUNK1!! make a sentence.", 0)]
    model = quality.fit([(quality.grams(t.encode()), y) for t, y in docs])
    for text in ("Plain words make a JUNK1!! sentence.", "CLICK$$$ now*** now***", "number 1 make"):
        s = quality.score(model, quality.grams(text.encode(), model["vocabulary"]))
        margin = (np.log(s / (1 - s)) - model["b"]) / model["a"]
        assert margin == pytest.approx(plain_quality(docs, text), abs=0.03)


@given(st.lists(st.sampled_from(["Plain", "JUNK!!", "a1", "é", "word"]), max_size=9).map(" ".join))
@settings(max_examples=50, deadline=None)
def test_grams_are_coded_reversibly(text):
    found = quality.grams(text.encode())
    assert {quality.decoded(quality.coded(g)) for g in found} == found and len(set(map(quality.coded, found))) == len(found)


@given(st.lists(st.lists(st.sampled_from(["Plain", "JUNK!!", "a1", "é", "word", "wooord"]), max_size=9).map(" ".join), min_size=1, max_size=4), st.data())
@settings(max_examples=100, deadline=None)
def test_places_are_those_of_the_grams(texts, data):
    """A vocabulary may lack any of a text's n-grams, and hold a pair without its words."""
    every = sorted({quality.coded(g) for t in texts for g in quality.grams(t.encode())})
    names = sorted(data.draw(st.sets(st.sampled_from(every))))
    held = quality.Vocabulary(names)
    for t in [*texts, "", "word strange Plain JUNK!! word word"]:
        places = held.places(t.encode()).tolist()
        assert len(set(places)) == len(places) and {names[k] for k in places} == {quality.coded(g) for g in quality.grams(t.encode())} & set(names)


def test_a_quality_model_takes_a_worker_little_memory():
    """Every Python worker holds the model: as many bytes an n-gram as its array rows and words need, not as Python objects take."""
    docs = [(" ".join(f"{'good' if k % 2 else 'bad'}{(k // 4 * 300 + j * 7) % 9000} common{j}" for j in range(600)), k % 2) for k in range(48)]
    sent = pickle.dumps(quality.fit([(quality.grams(t.encode()), y) for t, y in docs]), protocol=5)
    tracemalloc.start()
    model = pickle.loads(sent)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(model["weights"]) > 5_000 and held < 200 * len(model["weights"])


def test_a_training_task_lists_few_grams_at_once():
    rows = [(" ".join(f"w{k}x{j}" for j in range(8_000)), k % 2, k) for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["text", "y", "_id"])
    got = list(quality._gram_rows(iter([batch, batch.slice(0, 0)])))
    assert len(got) > 2 and max(b.num_rows for b in got) < 6
    assert [(i, y, set(g)) for b in got for i, y, g in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(k, y, {quality.coded(g) for g in quality.grams(t.encode())}) for t, y, k in rows]
    names = sorted(quality.coded(g) for g in quality.grams(rows[3][0].encode()))[::2]
    at = [r for b in got for r in quality._numbered(b.column(2), pa.array(names, pa.binary())).to_pylist()]
    found = [{quality.coded(g) for g in quality.grams(t.encode())} for t, _, _ in rows]
    assert at == [[k for k, g in enumerate(names) if g in have] for have in found]


def test_repeated_ids_train_once(make_docs, spark):
    docs = make_docs([(1, f"text number {k}") for k in range(50)] + [(k, f"other {k}") for k in range(2, 20)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 20)], "doc_id long, quality int")
    drawn = quality.sample(docs, labels, "quality", 4, 2, 100).collect()
    assert len({r["_id"] for r in drawn}) == len(drawn) and {r["_id"] for r in drawn} == {k for k in range(1, 20) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert len(quality.sample(docs, labels, "quality", 4, 2, 5).collect()) == 5


def test_texts_of_large_strings():
    from sightline.llm.session import texts

    batch = pa.RecordBatch.from_arrays([pa.array(["é", None], pa.large_string())], ["text"])
    assert texts(batch) == ["é".encode(), b""]


@pytest.mark.parametrize("through", ["accepted", "without_shared_lines", "representatives", "mixed_texts", "without_repeats"])
def test_clashing_columns_pass_through(make_docs, spark, odd_rows, through):
    """Operators that return the caller's rows leave every other column as it was, whatever its name, and take empty tables."""
    from tests.llm.conftest import CLASHES

    labels = spark.createDataFrame([], "doc_id long, quality int")
    shared = "This line is shared by several documents\n" + " ".join(f"passage{k}" for k in range(40))
    rows = [*odd_rows, *[(k, f"{shared}\nown {k}") for k in range(20, 25)], (20, f"{shared}\nown 20")]
    run = {
        "accepted": lambda d: quality.accepted(d, labels), "without_shared_lines": linededup.without_shared_lines, "representatives": simhash.representatives,
        "mixed_texts": mixing.mixed_texts, "without_repeats": cdc.without_repeats,
    }[through]
    docs = make_docs(rows)
    out = run(docs)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert got and all(r[c] == c for r in got for c in CLASHES) and all((r.lang, r.score, r.fp, r["rank"]) == (None, None, 1, 2) for r in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert run(make_docs([])).collect() == []
