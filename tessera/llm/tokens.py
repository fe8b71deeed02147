"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped.

Documents are dealt out by range of id and sorted, so partition k holds the k-th stretch of the
corpus. Each task writes one shard: ``NNNNN.bin`` (ids, little-endian, 16 bits where the vocabulary
fits, else 32), ``NNNNN.ids`` (the documents' ids) and ``NNNNN.off`` (64-bit starts within the shard, one more than it has documents).
Only one count per shard reaches the driver; their prefix sums are the shards' bases in ``index.json``.
A shard is written under a name of its attempt and then renamed, so a task that runs twice or dies
half way leaves either nothing or the same file.

Defined results: a null or empty text is just the end id; null ids come first; rows that share an id
are ordered by a hash of their text, then the text; rows equal in both are interchangeable; an empty table writes an
index without shards and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import array
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import Store, ship, table, tidy

END_ID = 2
#: Pieces whose ids a worker keeps, in two generations: when the younger is full the older goes.
CACHE_WORDS = 250_000
#: A shard for so much input, by the planner's estimate, and at least spark.sql.shuffle.partitions of them.
SHARD_BYTES = 128 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER, _MARK, _SPACE = "A-Za-zß-öø-ÿÀ-ÖØ-Þœ", ".,;:!?|*$%&#", r"\x20\x09-\x0D"
#: Letters up to a mark or space, the marks up to a space, or else all up to a space. A combining character is
#: none of the letters, so what the normaliser could compose stays in one piece.
_PLAIN = re.compile("[A-Za-zß-öø-ÿœ]+")
_PIECE = re.compile(f"[{_LETTER}]+(?![^{_SPACE}{_MARK}])|[{_MARK}]+(?![^{_SPACE}])|[^{_SPACE}]+")


def file_system(uri: str):
    """The pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def read_bytes(uri: str) -> bytes:
    where, path = file_system(uri)
    with where.open_input_file(path) as f:
        return f.read()


class Draft:
    """A file written under a name of its own, which takes its place when it is complete."""

    def __init__(self, uri: str):
        self.where, self.path = file_system(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.file = self.where.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def commit(self) -> None:
        self.file.close()
        self.where.move(self.draft, self.path)


def write_bytes(uri: str, data: bytes) -> None:
    f = Draft(uri)
    f.write(data)
    f.commit()


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file's numbers: memory-mapped where the store is a mounted folder, read otherwise."""
    from pyarrow import fs

    where, path = file_system(uri)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if where.get_file_info(path).size else np.zeros(0, dtype)
    return np.frombuffer(read_bytes(uri), dtype)


def byte_characters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """Encodes texts with the tokenizers library, piece by piece, keeping the pieces met before.

    The tokenizer's pre-tokenizer never joins what white space divides, nor letters and the marks
    behind them, so a text's ids are those of its pieces in turn; and its normaliser lower-cases, so
    A-Z may be lowered first in a text without combining marks, and in a piece of letters alone (nothing
    is composed there), but not where a special token could arise from it. ``check`` holds a
    tokenizer to both on a probe before it is used so; any other encodes whole texts."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.old: dict[str, bytes] = {}
        self.characters = byte_characters()
        self.code = "H" if self.dtype == "<u2" else "I"
        self.by_word = self.check()

    def _ids(self, text: str) -> bytes:
        return array.array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain_ids(self, letters: str) -> bytes:
        """Letters pass the normaliser and pre-tokenizer as they are, but for A-Z, so the model alone can take them."""
        letters = letters.encode().lower().decode()
        if not letters.isascii():
            letters = "".join([self.characters[b] for b in letters.encode()])
        return array.array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def check(self) -> bool:
        probe = "It's a Test\tof 12 words,\x0band\nÉtés ! don't  ﬁne\r\n— x's 'll a.b Äpfel|# naïve;: ÇA. \"So,\" e\u0301t STRASSE, ß?"
        if self._ids(probe) != b"".join(map(self._ids, self.pieces(probe))):
            return False
        letters = [w for w in "a i the The ABC Straße que naïve straße œuvre über réélection enjeux thlyatat zzyzx ÿþð".split() if _PLAIN.fullmatch(w)]
        return all(self._plain_ids(w) == self._ids(w) for w in letters)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "<|" in text:
            return _WORD.findall(text)
        data = text.encode("utf-8", "surrogatepass")
        if b"\xcc" in data or b"\xcd" in data:  # U+0300 to U+036F are all that can be composed with a letter of A-Z
            return _PIECE.findall(text)
        return _PIECE.findall(data.lower().decode("utf-8", "surrogatepass"))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        out = self[piece] = self.old.get(piece) or (self._plain_ids(piece) if _PLAIN.fullmatch(piece) else self._ids(piece))
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_word:
            return self._ids(text) + self.end
        return b"".join(map(self.__getitem__, self.pieces(text))) + self.end


_encoders: dict = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write_tokens(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> dict:
    """Write the token files of (doc_id, text) under ``out_dir`` and return the index."""
    ship(spark)
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files; no job
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, estimate // SHARD_BYTES))
    spark._jvm.org.apache.hadoop.fs.Path(out_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(out_dir))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # a hot id spreads over ranges, in the order of the rows within them
    ordered = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        files, docs_, at = None, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            files = files or {x: Draft(f"{out_dir}/{part:05d}.{x}") for x in ("bin", "off", "ids")}
            own = [enc.encode(t) for t in pdf["text"]]
            sizes = np.array([len(x) // len(enc.end) for x in own], np.int64)
            files["bin"].write(b"".join(own))
            files["off"].write((at + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype("<i8").tobytes())
            keys = np.zeros(len(pdf), [("known", "u1"), ("id", "<i8")])
            keys["known"], keys["id"] = pdf["doc_id"].notna(), pdf["doc_id"].fillna(0).astype("int64")
            files["ids"].write(keys.tobytes())
            docs_, at = docs_ + len(own), at + int(sizes.sum())
        tidy()
        if files:
            files["off"].write(np.array([at], "<i8").tobytes())
            for f in files.values():
                f.commit()
            yield pd.DataFrame({"shard": [part], "docs": [docs_], "tokens": [at], "dtype": [enc.dtype]})

    # one row a shard; ranges of ids are in the shards' order
    made = ordered.mapInPandas(write, "shard int, docs long, tokens long, dtype string").toPandas().sort_values("shard")
    ends = made["tokens"].cumsum()
    shards = [
        {"shard": int(s), "docs": int(d), "tokens": int(t), "base": int(e - t)}
        for s, d, t, e in zip(made["shard"], made["docs"], made["tokens"], ends, strict=True)
    ]
    index = {"dtype": made["dtype"].iloc[0] if len(made) else "<u2", "end_id": end_id, "tokens": int(ends.iloc[-1]) if len(made) else 0, "shards": shards}
    write_bytes(f"{out_dir}/index.json", json.dumps(index).encode())
    return index


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""
    ship(spark)
    where, path = file_system(f"{out_dir}/index.json")
    with where.open_input_file(path) as f:
        index = json.loads(f.read())
    dtype = index["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not index["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(x["shard"], x["docs"], x["base"]) for x in index["shards"]], "shard int, docs long, base long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, docs, base in zip(pdf["shard"], pdf["docs"], pdf["base"], strict=True):
                ids, off = mapped(f"{out_dir}/{shard:05d}.bin", dtype), mapped(f"{out_dir}/{shard:05d}.off", "<i8")
                raw = read_bytes(f"{out_dir}/{shard:05d}.ids")
                keys = np.frombuffer(raw, [("known", "u1"), ("id", "<i8")])
                for a in range(0, docs, 5000):
                    b = min(docs, a + 5000)
                    own = [np.asarray(ids[off[i] : off[i + 1]]) for i in range(a, b)]
                    out = {
                        "doc_id": pd.Series(keys["id"][a:b].astype(np.int64)).astype("Int64").where(pd.Series(keys["known"][a:b] == 1)),
                        "start": off[a:b] + base,
                        "n_tokens": off[a + 1 : b + 1] - off[a:b],
                        "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in own],
                    }
                    yield pd.DataFrame(out | ({"ids": [x.astype(np.int64) for x in own]} if with_ids else {}))

    return shards.repartition(max(1, len(index["shards"])), "shard").mapInPandas(read, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` under the shared folder and give what they hold, a row per document."""
    out_dir = Store(spark, "tokens").path("files")
    write_tokens(spark, docs, out_dir, tokenizer or default_tokenizer())
    return read_tokens(spark, out_dir)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(spark, table(spark, sf_dir, "documents"))
