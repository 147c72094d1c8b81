"""Token-id output in bit-plane shuffled files.

Documents are encoded with a given tokenizer file; ids are packed into chunks
of whole documents. In a chunk the ids are cut into blocks of a fixed size and
every block is transposed into byte planes (or bit planes), so that plane *p*
holds byte (bit) *p* of all ids next to one another; each plane is compressed
with zstandard. A file set is a folder with

* ``chunks``: one row a chunk: ``shard, chunk, start_in_shard, n_ids, block,
  bits, doc_ids, doc_lens, planes`` (a list of zstandard frames), and
* ``index``: one row a chunk with its place: ``shard, chunk, start, n_ids,
  n_docs, first_doc, last_doc``.

Parquet is only the container: Spark's commit protocol makes a rewritten task
harmless, and any file system that Spark knows will do.

Defined cases: null or empty texts give the end id alone; rows with the same id
are all written, next to each other (``order_by`` given); null ids sort first;
an empty table gives an empty file set; other columns are ignored; a document
longer than a chunk gets a chunk of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_text

BLOCK = 4096
CHUNK_IDS = 1 << 18
#: Words kept in a worker's table of encoded words; it is emptied when full.
CACHE_WORDS = 500_000

CHUNKS = ("shard int, chunk int, start_in_shard long, n_ids long, block int, bits boolean, "
          "doc_ids array<long>, doc_lens array<long>, planes array<binary>")
#: Code points that case mapping and composition treat one by one, without `<`
#: and `|`, which can start a special token.
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")
_PLAIN = re.compile(r"[!-;=?-{}~ß-öø-ÿ]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds(dict):
    """White-space separated word -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space before it splits a text, so a text's ids
    are those of its words in turn. Words of plain characters are split by the
    tokenizer's own pattern and their pieces go to its model; any other word
    takes the tokenizer's full path. That a tokenizer works this way is tried
    on a probe text; if it does not, whole texts are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.pieces: dict[str, bytes] = {"": b""}
        probe = "Don't stop,\nÉté 42!  Über-all we'll (see) x's 'tis Straße l'été:"
        self.by_word, self.by_piece = True, True
        if self.encode(probe) != self.whole(probe):
            self.clear()
            self.by_piece = False
            self.by_word = self.encode(probe) == self.whole(probe)

    def forget(self) -> None:
        self.clear()
        self.pieces = {"": b""}

    def whole(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            key = piece if piece.isascii() else self.byte_level.pre_tokenize_str(piece)[0][0]
            found = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(key)])
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces = {"": b""}
            self.pieces[piece] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if not self.by_piece:
            out = self.whole(word)
        elif m := _SIMPLE.fullmatch(word):
            out = self._piece(m[1]) + self._piece(m[2])
        elif _PLAIN.fullmatch(low := word.lower()):
            out = b"".join(map(self._piece, _SPLIT.findall(low)))
        else:
            out = self.whole(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        if self.by_piece and text.isascii() and "<|" not in text:  # special tokens are matched before case is mapped
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_WORDS: dict[str, WordIds] = {}


def words_of(path: str) -> WordIds:
    """One table a Python worker."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pack(ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = 3) -> list[bytes]:
    """Ids -> compressed planes, the highest byte (bit) last."""
    import zstandard

    n = -(-len(ids) // block) * block
    padded = np.zeros(n, dtype="<u4")
    padded[:len(ids)] = ids
    rows = padded.view(np.uint8).reshape(-1, block, 4)
    if bits:
        rows = np.unpackbits(rows, axis=2, bitorder="little")
    planes = rows.transpose(2, 0, 1)
    if bits:
        planes = np.packbits(planes, axis=2, bitorder="little")
    c = zstandard.ZstdCompressor(level=level)
    return [c.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def unpack(planes: list[bytes], n_ids: int, block: int = BLOCK, bits: bool = False) -> np.ndarray:
    """The ids that ``pack`` was given."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    width = block // 8 if bits else block
    raw = [np.frombuffer(d.decompress(p, max_output_size=max(1, -(-n_ids // block) * width)), np.uint8)
           for p in planes]
    rows = np.stack([r.reshape(-1, width) for r in raw])
    if bits:
        rows = np.unpackbits(rows, axis=2, bitorder="little")
    rows = rows.transpose(1, 2, 0)
    if bits:
        rows = np.packbits(rows, axis=2, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)[:n_ids]


def _encode(tokenizer: str, end_id: int | None, block: int, chunk_ids: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        docs: list[int | None] = []
        lens: list[int] = []
        size = 0

        def out() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()),
                pa.array([len(whole)], pa.int64()), pa.array([block], pa.int32()), pa.array([bits], pa.bool_()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())),
                pa.array([pack(whole, block, bits)], pa.list_(pa.binary()))],
                names=["shard", "chunk", "start_in_shard", "n_ids", "block", "bits", "doc_ids", "doc_lens", "planes"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = words.encode(text.as_py()) + end
                if docs and size + len(one) > 4 * chunk_ids:
                    yield out()
                    start, chunk, size = start + size // 4, chunk + 1, 0
                    ids, docs, lens = [], [], []
                ids.append(one)
                docs.append(doc)
                lens.append(len(one) // 4)
                size += len(one)
        if docs:
            yield out()
        words.forget()  # workers live on, for other operators too
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None,
                      order_by: str | None = "doc_id", block: int = BLOCK, chunk_ids: int = CHUNK_IDS,
                      bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the file set to ``path``.

    ``order_by="doc_id"``: shards hold ascending ids (range partitioned; rows of
    one id may span shards). ``None``: each input partition becomes a shard in
    the order in which it is read, without a shuffle."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    if order_by is not None:
        if order_by != id_col:
            raise ValueError("order_by must be the id column or None")
        # the text's hash deals out the rows of one repeated id
        rows = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
                .sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    chunks = rows.mapInArrow(_encode(tokenizer, end_id, block, chunk_ids, bits), CHUNKS)
    chunks.write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    done = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    (done.join(F.broadcast(_shard_starts(done)), "shard")
     .select("shard", "chunk", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_ids",
             F.size("doc_ids").alias("n_docs"), F.col("doc_ids")[0].alias("first_doc"),
             F.element_at("doc_ids", -1).alias("last_doc"))
     .write.parquet(f"{path}/index"))


def _shard_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each shard: one row a write task, so the window is small."""
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_start"))


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["n_ids"], row["block"], row["bits"])
                lens = np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                parts = [ids[e - n:e].tobytes() for n, e in zip(lens, ends)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lens, pa.int64()),
                        pa.array(lens, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file set: doc_id, start (ids before it in the whole set),
    n_tokens, ids_crc32, and with ``with_ids`` the ids as little-endian uint32."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", "start")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return (chunks.join(index, ["shard", "chunk"])
            .select("start", "n_ids", "block", "bits", "doc_ids", "doc_lens", "planes")
            .mapInArrow(_decode(with_ids), schema))


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)
