"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the characters themselves, so the number of n-grams grows with the input and no table of them is ever held
whole. Counts, continuation counts, discounts and back-off weights are aggregations and joins of tables dealt by n-gram.

Documents are dealt into blocks of neighbouring ids. A block asks for each of its different n-grams once; the questions
are joined with the sharded counts, order by order, and the answers go back to the block, where they meet its texts. So
what is joined grows with the different n-grams of a block and not with the characters of each document, and a task
holds one block's texts and answers. Where ids are not in the order of the files this stays right, but a block's
questions come from more tasks.

A document is kept if its perplexity is at most a high quantile of the trusted documents in its language. As a model
finds the text it was trained on too likely, documents are dealt to folds by the hash of their id, and each is scored by
the model of the other folds' trusted text: trusted and other documents are then measured alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.llm.common import cut

ORDER = 4
#: Stands before and after each text; also for the character NUL.
EDGE = "\x02"
#: Characters handled at once; bounds a task's memory.
CHUNK = 4_000_000
QUANTILE, LEAST_TRUSTED = 0.999, 100
FOLDS = 2
#: 2**13 neighbouring ids make a block in each fold.
BLOCK_BITS = 13
#: Bits of the filter for trusted ids. It only spares texts a shuffle; the join after it decides.
FILTER_BITS = 1 << 26
_NO_TEXT = (1 << 62) - 1
#: Rows of one id, or of none, in a block; an id is dealt by text if it has more rows and at least this share of all.
BLOCK_ROWS, HOT_SHARE = 4096, 1e-4
#: A text of more characters is a block of its own.
LONG_TEXT = 1 << 18


def _windows(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, points, starts, lengths): the texts with their edges in a row, and where the windows of n symbols begin."""
    pad = EDGE * (order - 1)
    joined = "".join(f"{pad}{t}{EDGE}" for t in texts).replace("\0", EDGE)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    after = np.cumsum(lengths + order - 1)
    inside = np.ones(len(joined), bool)
    for k in range(1, order):
        inside[after - k] = False
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.flatnonzero(inside), lengths


def _codes(symbols: np.ndarray, base: int, order: int) -> np.ndarray:
    """A number for the window that begins at each symbol; the last ones are cut short and meaningless."""
    codes = np.zeros(len(symbols), np.int64)
    for k in range(order):
        codes *= base
        codes[: len(symbols) - k] += symbols[k:]
    return codes


def _fits(base: int, order: int) -> bool:
    return base**order < 1 << 62


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > CHUNK:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def gram_counts(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """The different n-grams of the texts, each of ``order`` characters, and how often they occur."""
    joined, points, starts, _ = _windows(texts, order)
    alphabet = np.flatnonzero(np.bincount(points)).astype(np.uint32)
    if not _fits(len(alphabet), order):
        grams, counts = np.unique(np.array([joined[i : i + order] for i in starts.tolist()]), return_counts=True)
        return grams.tolist(), counts
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    codes, counts = np.unique(_codes(place[points], len(alphabet), order)[starts], return_counts=True)
    digits = np.stack([codes // len(alphabet) ** k % len(alphabet) for k in range(order - 1, -1, -1)], axis=1)
    return np.ascontiguousarray(alphabet[digits]).view(f"<U{order}").ravel().tolist(), counts


class Answers:
    """ln p of the n-grams of one block."""

    def __init__(self, grams: list[str], values: np.ndarray, order: int):
        self.order, points = order, np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        self.alphabet = np.flatnonzero(np.bincount(points)).astype(np.uint32)
        self.known = dict(zip(grams, values.tolist(), strict=True)) if not _fits(len(self.alphabet), order) else None
        if self.known is None:
            self.place = np.zeros(int(self.alphabet[-1]) + 1, np.int64)
            self.place[self.alphabet] = np.arange(len(self.alphabet))
            codes = _codes(self.place[points], len(self.alphabet), order)[::order]
            by_code = np.argsort(codes)
            self.codes, self.values = codes[by_code], values[by_code]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sum of ln p) of each text; the edge after a text is one of its symbols."""
        joined, points, starts, lengths = _windows(texts, self.order)
        if self.known is not None:
            values = np.array([self.known[joined[i : i + self.order]] for i in starts.tolist()])
        else:
            codes = _codes(self.place[points], len(self.alphabet), self.order)[starts]
            values = self.values[np.searchsorted(self.codes, codes)]
        return lengths, np.add.reduceat(values, np.cumsum(lengths) - lengths)


def fold_of(doc_id: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text)), F.lit(FOLDS)).cast("int")


def with_blocks(own: DataFrame) -> DataFrame:
    """``own`` (doc_id, text and others) with block: neighbouring ids, but rows without an id, rows of an id that repeats very often and
    long texts are dealt by their texts into blocks of about BLOCK_ROWS rows, or one text."""
    ids = cut(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("doc_id").isNull() | (F.col("n") > BLOCK_ROWS)))
    rows = own.agg(F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.count(F.lit(1)) * F.lit(HOT_SHARE))).alias("most"))  # one row
    # At most 1 / HOT_SHARE rows, and the one of null.
    hot = ids.join(F.broadcast(rows), how="cross").filter(F.col("doc_id").isNull() | (F.col("n") > F.col("most")))
    hot = cut(hot.select(F.col("doc_id").alias("__id"), F.ceil(F.col("n") / BLOCK_ROWS).alias("__parts")))
    by_text = F.when(F.length("text") > LONG_TEXT, F.xxhash64("text", F.lit("long"))).when(F.col("__parts").isNotNull(), F.xxhash64("doc_id", F.pmod(F.xxhash64("text"), F.col("__parts"))))
    # Blocks by text are below zero, those by id, moved by half, above.
    block = F.coalesce(by_text.bitwiseOR(F.lit(-(1 << 63))), F.shiftright("doc_id", BLOCK_BITS) + F.lit(1 << (63 - BLOCK_BITS)))
    return own.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("block", block).drop("__id", "__parts")


def _maybe_trusted(own: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``own`` (doc_id, text, fold) whose id may be among ``ids``: all of these and, by chance, others.

    The filter has a fixed size. Where ids are so many that it is full, all rows pass.
    """
    at = lambda df: df.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("__at"))
    one = F.col("__at") + 1
    rows = at(ids).groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:  # at most FILTER_BITS / 32768 rows of 4 KB
        begin = (row["bucket"] - 1) * 4096
        bits[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    sent = own.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(3).to_numpy()
            found = (sent.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(found.astype(bool))).select([0, 1, 2])

    return at(own.select("doc_id", "text", "fold")).mapInArrow(run, "doc_id long, text string, fold int")


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, gram, c) of a table (text, fold): each fold's texts are counted for the models of all other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for fold in np.unique(folds).tolist():
                for some in _chunks(batch.column(0).filter(pa.array(folds == fold)).to_pylist()):
                    grams, counts = gram_counts(some, order)
                    yield pa.RecordBatch.from_arrays([pa.array([fold] * len(grams), pa.int32()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["fold", "gram", "c"])

    counted = texts.filter("text <> ''").select("text", "fold").mapInArrow(run, "fold int, gram string, c long").groupBy("fold", "gram").agg(F.sum("c").alias("c"))
    others = F.array_except(F.array(*map(F.lit, range(FOLDS))), F.array("fold"))
    return counted.select(F.explode(others).alias("model"), "gram", "c").groupBy("model", "gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3), from the numbers of n-grams seen once to four times; 0.5, 1, 1.5 where one of those is 0."""
    seen = counts.groupBy("model").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    full = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = lambda k, usual: F.when(full, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.0)), F.lit(float(k)))).otherwise(F.lit(usual)).alias(f"d{k}")
    return seen.select("model", d(1, 0.5), d(2, 1.0), d(3, 1.5))


def levels(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """From counts (model, gram, c), for each order from 1: (model, gram, rate), the discounted rate of each seen n-gram,
    and (model, context, weight), the back-off weight of each seen context."""
    out, level = [], counts
    for k in range(order, 0, -1):
        few = F.broadcast(discounts(level))  # a row a fold
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        cuts = level.join(few, "model").select("model", "gram", F.substring("gram", 1, k - 1).alias("context"), "c", taken.alias("taken"))
        contexts = cut(cuts.groupBy("model", "context").agg(F.sum("c").alias("total"), F.sum("taken").alias("left")))
        rates = cuts.join(contexts if k > 1 else F.broadcast(contexts), ["model", "context"]).select("model", "gram", ((F.col("c") - F.col("taken")) / F.col("total")).alias("rate"))
        out.append((rates, contexts.select("model", "context", (F.col("left") / F.col("total")).alias("weight"))))
        if k > 1:
            level = cut(level.groupBy("model", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    return out[::-1]


def probabilities(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(model, gram, p) for every n-gram asked for: each order interpolates with the one below, the first with 1 / (V + 1)
    for V known symbols, so that the symbols that were never seen share one place."""
    sets = [asked]
    for k in range(len(model) - 1, 0, -1):
        sets.append(sets[-1].select("model", F.substring("gram", 2, k).alias("gram")).distinct())
    size = model[0][0].groupBy("model").agg(F.count(F.lit(1)).alias("size"))
    p = sets[-1].select("model").distinct().join(F.broadcast(size), "model", "left").select("model", F.lit("").alias("suffix"), (1.0 / (F.coalesce("size", F.lit(0)) + 1)).alias("below"))
    for k, ((rates, weights), grams) in enumerate(zip(model, sets[::-1], strict=True), 1):
        keyed = grams.select("model", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        value = F.coalesce("rate", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")
        if k == 1:  # a row a fold each
            p, weights = F.broadcast(p), F.broadcast(weights)
        p = keyed.join(p, ["model", "suffix"]).join(weights, ["model", "context"], "left").join(rates, ["model", "gram"], "left").select("model", "gram", value.alias("p"))
        if k < len(model):
            p = p.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return p


def questions(own: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, model, gram): the different n-grams of each block's texts; a fold is scored by its own model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (1, 2)], axis=1)
            for block, fold in np.unique(keys, axis=0).tolist():
                mine = pa.array((keys == (block, fold)).all(axis=1))
                for some in _chunks(batch.column(0).filter(mine).to_pylist()):
                    grams = gram_counts(some, order)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(grams), pa.int64()), pa.array([fold] * len(grams), pa.int32()), pa.array(grams, pa.string())], names=["block", "model", "gram"])

    return own.filter("text <> ''").select("text", "block", "fold").mapInArrow(run, "block long, model int, gram string").distinct()


def pack(own: DataFrame) -> DataFrame:
    """(block, model, rows): the rows of each block as compressed Arrow tables; texts are shuffled in this form.

    Null and empty texts need no answers, so they stay in blocks by task, however many they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, options = TaskContext.get().partitionId(), pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            blank = np.array([not x for x in batch.column("text").to_pylist()], bool)
            keys = np.stack([np.where(blank, _NO_TEXT - part, batch.column("block").to_numpy()), np.where(blank, 0, batch.column("fold").to_numpy())], axis=1)
            found = np.unique(keys, axis=0).tolist() if len(keys) else []
            out = []
            for key in found:
                rows, sink = batch.select(["doc_id", "lang", "text"]).filter(pa.array((keys == key).all(axis=1))), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([f for _, f in found], pa.int32()), pa.array(out, pa.binary())], names=["block", "model", "rows"])

    return own.mapInArrow(run, "block long, model int, rows binary")


def score(packed: DataFrame, answers: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity) of the blocks' texts; n_symbols 0 and null for blank ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("perplexity", pa.float64())])

    def run(_, blocks: pa.Table, found: pa.Table) -> pa.Table:
        known = Answers(found["gram"].to_pylist(), found["ln_p"].to_numpy(), order) if found.num_rows else None
        out = [schema.empty_table()]
        for rows in blocks["rows"] if blocks.num_rows else []:
            table = pa.ipc.open_stream(rows.as_buffer()).read_all()
            texts = table["text"].to_pylist()
            if known is None:
                n, perplexity = pa.array([0] * len(texts), pa.int64()), pa.nulls(len(texts), pa.float64())
            else:
                parts = [known.score(some) for some in _chunks(texts)]
                n, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
                perplexity = np.exp(-sums / n)
            out.append(pa.table([table["doc_id"], table["lang"], n, perplexity], schema=schema))
        return pa.concat_tables(out)

    keys = ["block", "model"]
    return packed.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(run, "doc_id long, lang string, n_symbols long, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """One row a document: doc_id, lang, n_symbols, perplexity, threshold, kept.

    ``trusted`` has the doc_id of trusted documents; all of them are counted, repeated ids once each row of ``docs``.
    The threshold is the quantile of the language's trusted documents, or of all of them where the language
    (null is one) has fewer than ``least_trusted``. Null and empty texts have no symbols and no perplexity and are not
    kept. Without trusted documents there is no model: perplexity is 1 and everything with text is kept. An empty table stays
    empty. Rows that repeat are judged each; a perplexity equal to the threshold is kept. Texts may be of any length. Ids are
    cast to long, and a text that is no number raises. Other columns are not read, whatever their names.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    own = with_blocks(own.withColumn("fold", fold_of(F.col("doc_id"), F.col("text"))))
    ids = trusted.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
    counts = cut(count_grams(_maybe_trusted(own, ids).join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), order))
    asked = cut(questions(own, order))
    p = probabilities(asked.select("model", "gram").distinct(), levels(counts, order))
    answers = asked.join(p, ["model", "gram"]).select("block", "model", "gram", F.log("p").alias("ln_p"))
    scored = cut(score(pack(own), answers, order))
    known = scored.filter("n_symbols > 0").join(ids, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    by_lang = known.groupBy("lang").agg(at.alias("own"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_trusted).select(F.col("lang").alias("l"), "own")
    overall = known.agg(at.alias("overall"))
    judged = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(overall), how="cross")  # one row
    threshold = F.coalesce("own", "overall")
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), ((F.col("n_symbols") > 0) & (threshold.isNull() | (F.col("perplexity") <= threshold))).alias("kept"))
