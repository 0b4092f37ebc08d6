"""Operators 1, 9 and 10 against the public libraries."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash

from sparkbrook.llm import subwords, token_counts, token_files
from sparkbrook.llm.queries import op1_token_counts, op9_merge_dropout, op10_token_files

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "A", "the", "ing,", "x.", "é", "ñ", "日", "12", "!", "--", "<|endoftext|>", "<|", "|>", "\xa0", "\u2003", " don't", "=", "\x1c", "😀", "́", "Σ", "İ", "\r\n", "<s>", "<0x0A>"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    return ["", " ", "\n\n", "a" * 5000, " " * 3000, *["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(800)]]


@pytest.fixture(scope="module")
def byte_library():
    return tokenizers.Tokenizer.from_file(BYTE)


def test_every_prefix_has_its_exact_count(texts, byte_library):
    t = token_counts.PrefixTable(BYTE)
    count = lambda s: len(byte_library.encode(s, add_special_tokens=False).ids)
    for s in texts:
        assert t.count(s) == count(s)
        if len(s) < 100:
            counts = [count(s[: i + 1]) for i in range(len(s))]
            assert np.cumsum(np.frombuffer(t.deltas(s), np.int8), dtype=int).tolist() == counts
            for limit in (0, 1, 4):
                assert (t.count(s), token_counts.longest_within(t.deltas(s), limit)) == (count(s), max((i + 1 for i, c in enumerate(counts) if c <= limit), default=0))


def test_the_split_pattern_agrees_on_every_code_point(byte_library):
    t = token_counts.PrefixTable(BYTE)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 50 == 0)]
    for at in range(0, len(points), 20):
        s = "".join(f"a{c}1{c}{c}!" for c in points[at : at + 20])
        assert [len(w.encode()) for w in t.words(s)] == [len(w) for w, _ in byte_library.pre_tokenizer.pre_tokenize_str(s)]


def test_token_counts_query(spark, byte_library):
    rows = [(1, "one two"), (2, None), (2, ""), (None, "<|endoftext|> x"), (4, "word " * 3000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens long")
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.count_tokens(df, BYTE).collect()}
    for i, t in rows:
        r = got[i, len((t or "").encode())]
        assert r.n_tokens == len(byte_library.encode(t or "", add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 1024)
        assert token_counts.prefix_counts(r.prefix_deltas).tolist()[-1:] == [r.n_tokens] * bool(t) and len(r.prefix_deltas) == len(t or "")
    assert got[4, 15000].over_limit and 4000 < got[4, 15000].fit_chars < 15000
    for limit in (1, 2, 500):
        fits = {x.doc_id: x.fit_chars for x in token_counts.within_budget(token_counts.count_tokens(df, BYTE), limit).where("doc_id in (1, 4)").collect()}
        for i, t in rows:
            if i in fits:
                size = lambda s: len(byte_library.encode(s, add_special_tokens=False).ids)
                assert size(t[: fits[i]]) <= limit and (fits[i] == len(t) or size(t[: fits[i] + 1]) > limit)
    assert token_counts.count_tokens(df.limit(0), BYTE).count() == 0


def test_token_counts_over_the_table(spark, byte_library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    ids = byte_library.encode_batch(list(docs.values()), add_special_tokens=False)
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len(t.encode()), len(e.ids), len(e.ids) > 1024) for (i, t), e in zip(docs.items(), ids, strict=True)}


def test_token_files_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, op10_token_files(spark, "/root/testdata/sf0.001").collect())) == sorted(brute_token_rows(rows))


def test_without_dropout_the_pieces_are_the_librarys(texts):
    library, p = sentencepiece.SentencePieceProcessor(model_file=PIECE), subwords.Pieces(PIECE, 0.0)
    for s in texts:
        assert np.frombuffer(p.encode(s), "<u4").tolist() == library.encode(s)


def test_dropout_varies_repeats_and_decodes(texts):
    a, b, c = subwords.Pieces(PIECE), subwords.Pieces(PIECE), subwords.Pieces(PIECE, subwords.RATE, 99)
    differ = 0
    for k, s in enumerate([*texts, "▁ x▁y ▁"]):
        ids = a.encode(s, k)
        assert a.decode(ids) == s and b.encode(s, k) == ids
        assert c.decode(c.encode(s, k)) == s
        differ += c.encode(s, k) != ids
    assert differ > 50
    prose = "the quick brown fox jumps over the lazy dog and continues running through fields " * 40
    plain = len(subwords.Pieces(PIECE, 0.0).encode(prose)) // 4
    assert plain < len(a.encode(prose, 1)) // 4 < 2 * plain
    assert a.encode(prose, 1) != a.encode(prose, 2)


def plain_dropout(p, chunk, base):
    """Merging with every candidate's own draw, without trees."""
    pieces, gone = list(enumerate(chunk.replace(" ", subwords.SPACE))), set()
    while True:
        pairs = [(p.ranks[x + y], i, len(x), len(x + y)) for (i, x), (_, y) in zip(pieces[:-1], pieces[1:], strict=True) if x + y in p.ranks and (i, len(x), len(x + y)) not in gone]
        if not pairs:
            return p.ids_of([x for _, x in pieces])
        _, i, left, both = min(pairs)
        if subwords.skipped_at(base, subwords.merge_key(i, left, both), p.rate_below):
            gone.add((i, left, both))
            continue
        k = next(k for k, (j, _) in enumerate(pieces) if j == i)
        pieces[k : k + 2] = [(i, pieces[k][1] + pieces[k + 1][1])]


def test_dropout_draws_every_candidate_of_every_occurrence():
    p = subwords.Pieces(PIECE, 0.3)
    for key in range(40):
        text = "the international\n responsibilities http://example.org/understanding-everything日本語 international " + "thisandthat" * 6
        found = p.chunks(" " + text)
        expected = [i for c, b in zip(found, p.bases(len(found), key).tolist(), strict=True) for i in plain_dropout(p, c, b)]
        assert np.frombuffer(p.encode(text, key), "<u4").tolist() == expected


def test_long_chunks_have_many_segmentations():
    p = subwords.Pieces(PIECE)
    word = " internationalization"
    for chunk, least in ((word, 20), (" https://example.org/a/very/long/path/without/any/space/index.html", 60), (" manager", 4)):
        assert len({p.encode(chunk[1:], k) for k in range(200)}) >= least
    # each skip at its rate: texts stay whole as often as their candidates allow
    ids, came = p.segment(word)
    whole = sum(p.encode(word[1:], k) == subwords.pack(*ids) for k in range(4000)) / 4000
    assert whole >= 0.9 ** len(came) - 0.03


def test_round_trip_query(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, "x\n▁")], "doc_id long, text string")
    got = subwords.round_trip(df, PIECE).collect()
    assert all(r.lossless for r in got) and len(got) == 4
    encoded = subwords.encode_documents(df, PIECE)
    assert sorted(r.text for r in subwords.decode_documents(encoded, PIECE).collect()) == sorted(["a b", "a b", "", "x\n▁"])
    assert subwords.encode_documents(df.limit(0), PIECE).count() == 0


def test_copies_of_a_document_vary(spark):
    text = "international responsibilities of understanding everything " * 3
    df = spark.createDataFrame([(1, text)] * 4 + [(2, text)] * 2, "doc_id long, text string").coalesce(1)
    first, again = ([(r.doc_id, tuple(r.ids)) for r in subwords.encode_documents(df, PIECE).collect()] for _ in range(2))
    assert first == again and len(set(first)) == 6


def test_round_trip_over_the_table(spark):
    got = op9_merge_dropout(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.where("not lossless").count() == 0


def text_hash(text):
    """xxhash64 of Spark, signed; of null, its seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_token_rows(rows):
    library = tokenizers.Tokenizer.from_file(WORD)
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, texts, tmp_path):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(None, "no id"), (2000, None), (2001, "word " * 20000)]
    rows += [(2002, f"one id, text {k} " + "and more " * (k % 5)) for k in range(300)] + [(None, f"none {k}") for k in range(50)] + [(2003, "equal")] * 20
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids long")
    folder = f"file://{tmp_path}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one range
    token_files.write_tokens(df, WORD, folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(tuple(r) for r in token_files.token_digest(spark, folder).na.fill(-1).collect())
    assert got == sorted((-1 if i is None else i, *rest) for i, *rest in brute_token_rows(rows))
    written = token_files.read_tokens(spark, folder)
    assert written.groupBy("file_range", "row").count().where("count > 1").isEmpty()
    assert written.where("doc_id = 2002").select("file_range").distinct().count() > 1  # one id is many ranges
    import pyarrow.parquet as pq

    f = pq.ParquetFile(next(p for p in (tmp_path / "t").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows))
    meta = f.metadata.row_group(0)
    assert "DELTA_BINARY_PACKED" in meta.column(0).encodings and meta.column(0).has_column_index and meta.column(2).has_offset_index


def test_token_files_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(df, WORD, folder)
    assert token_files.token_digest(spark, folder).count() == 0


def test_stops_are_split_as_before_and_sought_by_themselves():
    """The search for a stop that ends a word begins with the stop, which the engine can skip to."""
    plain = re.compile(rb"(?<=[a-z0-9])([.,])(?=\s|$)")
    r = random.Random(3)
    for _ in range(3_000):
        data = "".join(r.choice("ab9.,,) \n\té") for _ in range(r.randrange(25))).encode()
        assert token_files.STOP.sub(rb" \1", data) == plain.sub(rb" \1", data)
    assert token_files.STOP.pattern.startswith(rb"([.,])")
