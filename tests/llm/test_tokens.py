import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import bpe, token_counts
from quillstone.llm.queries import QUERIES
from quillstone.llm.text import Memo

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = "ab's é́<|endoftext|>Σς 1٣\n\t\x85😀-　"


def strings():
    rng = random.Random(3)
    fixed = ["", " ", "Σ ΑΣ", "<|startoftext|>hi<|endoftext|> <|endoftext|>x", "a  b   c \n\n d\t", "İstanbul ǅ ß", "aa" * 700, "x\x1cy \x1f", "\n a\n", " ́ a", "it's I'LL 12345", "!\x1fa", "\x1c\x1d!", "´\x1é \x1f"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(500)]


@pytest.fixture(scope="module")
def texts(docs):
    return strings() + [r[0] for r in docs.select("text").collect()]


def test_ids_and_decoding_equal_the_library(texts):
    own, library = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    for t, got, want in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got == (len(want.ids), " ".join(map(str, want.ids)), library.decode(want.ids, skip_special_tokens=False)), t[:80]
        assert own.decode(want.ids) == got[2]


def test_segment_tree_takes_the_leftmost_lowest_pair():
    own, library = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    words = ["a" * n for n in range(1, 70)] + ["banana" * 30, "tt", "thethethe"]
    assert own.encode_pieces([w.encode() for w in words]) == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_runs_of_marks_and_separators_equal_the_library():
    """White space, separators from \\x1c to \\x1f, marks, letters and digits in any order, 30,000 times."""
    rng = random.Random(11)
    alphabet = "!?.-\x1c\x1d\x1e\x1f´́_a1Zß \t\x85'<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(30_000)]
    for path, own in ((WORD, bpe.Bpe(WORD)), (BYTE, token_counts.Counter(BYTE))):
        library = Tokenizer.from_file(path)
        want = [e.ids for k in range(0, 30_000, 1000) for e in library.encode_batch(texts[k : k + 1000], add_special_tokens=False)]
        if path == WORD:
            assert [x[1] for x in own.encode_batch(texts)] == [" ".join(map(str, x)) for x in want]
        else:
            assert own.count(texts) == [len(x) for x in want]


def test_memos_are_bounded():
    own, library = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    own.words, own.said = Memo(5_000), Memo(3_000)
    for k in range(20):
        text = " ".join(["the", "again", *(f"w{k}x{i}" for i in range(40))])
        assert own.encode_batch([text])[0][0] == len(library.encode(text, add_special_tokens=False).ids)
        assert all(len(m.held) + len(m.before) < 150 for m in (own.words, own.said))
        assert "the" in own.words.held or "the" in own.words.before


def test_a_task_leaves_no_vocabulary_in_its_worker(spark):
    """Workers live on beside their executor, and hold what tasks leave."""
    texts = ["Hello there, 12 WORDS", None, ""]
    (got,) = bpe.digest_udf(WORD).func(iter([pa.array(texts, pa.string())]))
    assert got.field("n_tokens").to_pylist() == [x[0] for x in bpe.Bpe(WORD).encode_batch([t or "" for t in texts])]
    assert bpe.load.cache_info().currsize == 0


def test_batches_are_alike_in_bytes():
    rng = random.Random(1)
    parts = ["é" * rng.randrange(1, 30) for _ in range(5000)] + ["x" * 9000]
    found = token_counts.batches(parts, 10_000)
    sizes = [sum(len(p.encode()) for p in b) for b in found]
    assert sorted(p for b in found for p in b) == sorted(parts) and max(sizes) - min(sizes) < 10_000 and max(sizes) < 20_000
    assert token_counts.batches([]) == [[]] and token_counts.batches(["a"]) == [["a"]]


def test_counts_equal_the_library(texts):
    own, library = token_counts.Counter(BYTE), Tokenizer.from_file(BYTE)
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_parts_are_the_text():
    for t in strings():
        assert "".join(token_counts.Counter.parts(t)) == t


def test_odd_rows(odd, none):
    library = Tokenizer.from_file(WORD)
    got = bpe.encode_digests(odd, WORD).select("text", "bpe.*").collect()
    assert len(got) == odd.count() and bpe.encode(none, WORD).count() == 0
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    counted = token_counts.token_counts(odd, BYTE, limit=3)
    assert set(odd.columns) <= set(counted.columns) and token_counts.token_counts(none, BYTE).count() == 0
    library = Tokenizer.from_file(BYTE)
    for r in counted.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 3)


def test_round_trip_through_columns(spark, docs):
    coded = bpe.encode(docs, WORD)
    back = bpe.decode(coded.select("doc_id", "bpe.ids", F.col("bpe.decoded").alias("d")), WORD, "ids", "again")
    assert back.where("again <> d").isEmpty()


def test_queries(spark, sf, docs):
    one = QUERIES["op1_bpe"](spark, sf)
    assert one.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and one.count() == docs.count()
    two = QUERIES["op2_token_counts"](spark, sf)
    assert two.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and two.count() == docs.count()


def test_all_code_points_equal_the_library():
    """Each code point within a word, after a capital and beside a mark: classes and small letters are the library's."""
    own, library = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{chr(c)}b X{chr(c)}!" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for k in range(0, len(texts), 256):
        want = library.encode_batch(texts[k : k + 256], add_special_tokens=False)
        assert [x[1] for x in own.encode_batch(texts[k : k + 256])] == [" ".join(map(str, x.ids)) for x in want]
