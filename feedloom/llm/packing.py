"""Packing of tokenised documents into sequences of binary lengths, none of which crosses a document."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import byte_texts, map_batches

LONGEST = 2048
END_ID = 1
MEMO_WORDS = 300_000  # words whose ids a worker keeps; bounds memory only
MEMO_WORD_BYTES = 64
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # all but the apostrophe, which starts contractions
TEXT_AT_ONCE = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of words, kept in a bounded memo.

    The vocabulary drops white space and never joins letters across it, so the ids of a text are those of its
    words, cut at ASCII white space, one after the other; it lower-cases, so words are looked up in lower case.
    Lower-case words of Latin-1 letters with trailing punctuation, which the vocabulary cuts into just these two
    parts, go straight to its merges; all others, capitals among them, through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def part(self, word: bytes) -> bytes:
        """Ids of one run of letters or of punctuation."""
        return array("I", [t.id for t in self.merge("".join([self.letters[b] for b in word]))]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if core.isalpha():
            plain = core.islower()
        else:
            text = core.decode()
            plain = text.isalpha() and max(text) < "\u0100" and text.islower()
        if plain and len(core) <= MEMO_WORD_BYTES:
            tail = word[len(core):]
            ids = (self[core] if tail else self.part(core)) + (self.part(tail) if tail else b"")
        else:
            ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(word) <= MEMO_WORD_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if b"<|" not in text:  # special tokens are matched before the text is lower-cased
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Whole pieces of `longest` (a power of two), then the powers of two of the rest, largest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in reversed(range(longest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    A document is its ids followed by END_ID; a null text is empty and gives one piece. It is cut into pieces whose
    lengths are powers of two, and every piece is a sequence of its own: sequences of one `bucket` (the power)
    are equally long and need no padding, and none holds more than one document. `ids` are little-endian
    unsigned 32-bit. sequence_id counts pieces inside a bucket and partition; it needs no shuffle, and a task
    that runs again gives the same. Other columns are ignored; repeated rows are documents of their own.

    `tokenizer` is the path of a vocabulary file, readable on every machine.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer), array("I", [END_ID]).tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), byte_texts(batch.column(1))
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and size < TEXT_AT_ONCE:
                    size += len(texts[last] or b"")
                    last += 1
                rows: list[tuple] = []
                for name, text in zip(names[first:last], texts[first:last]):
                    ids = words.encode(text or b"") + end
                    start, tokens = 0, len(ids) // 4
                    for length in binary_lengths(tokens, longest):
                        rows.append((name, start, length, ids[4 * start:4 * (start + length)], tokens))
                        start += length
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["doc_id", "start", "length", "ids", "doc_tokens"])
                first = last

    pieces = map_batches(docs.select("doc_id", "text"), over, SCHEMA)
    bucket = F.log2("length").cast("int")
    return (pieces.withColumn("bucket", bucket)
            .withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces as one folder per length, which a trainer can batch without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
