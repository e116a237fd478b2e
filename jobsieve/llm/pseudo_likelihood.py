r"""LM scoring by masked pseudo-likelihood.

A network predicts every word of a text from SIDE words before and SIDE words behind it; a text's score is the sum of
the logarithms of these conditional probabilities, mixed with what the rest of the corpus says.

* Words are runs of UTF-8 bytes between ASCII white space; characters of scripts without spaces (by their leading byte) are
  words of their own. Every word has a 64-bit hash, made in numpy for all words of a block at once. The network reads a word
  as one of INPUTS hashed embeddings and predicts one of TOKENS tokens; the corpus memory uses the whole hash.
* Network: one embedding per token, scaled by place, a tanh layer, and a softmax in two steps (class, token in class).
  Tasks train a copy each, from the same start, over all words of their documents (Adam in numpy); Spark adds the
  weights, weighted with the number of words, and only their mean reaches the driver. This is done ROUNDS times.
* Memory: texts are cut into chunks behind words whose hash is divisible by SPAN, so equal passages are cut alike
  wherever they stand. Spark counts the chunks of the whole corpus. A chunk found n other times has probability
  share + (1 - share) * p, with share = n / (n + PRIOR) and p the product of the network's probabilities of its words.
  The chunk that is scored never counts for itself. What is counted grows with the corpus, as tables, never broadcast by hint.

No words (NULL, empty, white space): 0 words, log-likelihood 0, NULL mean. Texts may have any length: they are worked on in
blocks of words. Equal rows each get a row and are evidence for one another. An empty table gives an empty result. Columns
other than the id and the text are ignored, so their names cannot clash. Equal tables in equal partitions give equal networks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from jobsieve.llm.common import saved

CLASSES = 32            # of tokens, and tokens of a class
TOKENS = CLASSES * CLASSES
INPUTS = 8 * TOKENS     # embeddings
EDGE = INPUTS           # the one beyond the ends of a text
SIDE = 2
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]
WIDTH = 16
BLOCK = 1 << 14         # words of a training step
RATE = 0.01
ROUNDS = 1
SEED = 11
SPAN = 12               # words of a chunk, on average
PRIOR = 1.0
BYTES = 1 << 22         # of texts that are worked on at once (one text may be longer)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SPACE, WIDE = np.zeros(256, bool), np.zeros(256, np.int8)
SPACE[list(b" \t\n\v\f\r")] = True
WIDE[0xE0:0xF0] = 3     # length of a character that is a word, by its leading byte
WIDE[0xF0:0xF8] = 4
WIDE[0xE2] = 0          # punctuation and symbols stay in their words

WEIGHTS = [(INPUTS + 1, WIDTH), (len(PLACES), WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, CLASSES),
           (CLASSES, CLASSES)]


def _hashes(begin: np.ndarray, sizes: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of values; runs begin at `begin`, and `starts` are their places in `values`."""
    powers = np.cumprod(np.full(sizes.max(), MULTIPLIER))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    found = np.add.reduceat((values + np.uint64(1)) * powers[place], begin)
    found ^= found >> np.uint64(29)
    found *= MULTIPLIER
    return found ^ (found >> np.uint64(32))


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word of a run of bytes."""
    space = SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    wide = np.flatnonzero(WIDE[raw])
    starts[wide] = True
    behind = wide + WIDE[raw[wide]]
    behind = behind[behind < len(raw)]
    starts[behind] |= ~space[behind]
    first = np.flatnonzero(starts)
    if not len(first):
        return first, np.empty(0, np.uint64)
    letters = np.flatnonzero(~space)                    # the bytes of the words lie behind one another there
    begin = np.searchsorted(letters, first)
    sizes = np.diff(np.append(begin, len(letters)))
    return first, _hashes(begin, sizes, raw[letters].astype(np.uint64), begin)


def batch_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first word of each, hashes of all words) of texts with words, about BYTES at a time."""
    def made(rows: list[int], raw: list[bytes]):
        begin = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        at, found = words(np.frombuffer(b" ".join(raw), np.uint8))
        first = np.searchsorted(at, begin)
        some = np.diff(np.append(first, len(at))) > 0
        return np.asarray(rows)[some], first[some], found

    rows, raw, size = [], [], 0
    for i, text in enumerate(texts):
        if text:
            own = text.encode("utf-8", "surrogatepass")
            if rows and size + len(own) > BYTES:
                yield made(rows, raw)
                rows, raw, size = [], [], 0
            rows.append(i)
            raw.append(own)
            size += len(own)
    if rows:
        yield made(rows, raw)


def windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of every word, and the embeddings at PLACES around it; texts lie behind one another and start at `first`."""
    own = ((hashes >> np.uint64(20)) % np.uint64(INPUTS)).astype(np.int32)
    spaced = np.full(len(own) + SIDE * (len(first) + 1), EDGE, np.int32)
    start = np.zeros(len(own), np.int64)
    start[first] = 1
    at = np.arange(len(own)) + SIDE * np.cumsum(start)
    spaced[at] = own
    return own % TOKENS, np.stack([spaced[at + k] for k in PLACES], 1)


def chunks(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and 64-bit hash of every chunk; a chunk ends behind a word whose hash SPAN divides, and with its text."""
    if not len(hashes):
        return np.empty(0, np.int64), hashes
    starts = np.zeros(len(hashes), bool)
    starts[1:] = (hashes[:-1] % np.uint64(SPAN)) == 0
    starts[first] = True
    begin = np.flatnonzero(starts)
    return begin, _hashes(begin, np.diff(np.append(begin, len(hashes))), hashes, begin)


class Network:
    """Weights in the order of WEIGHTS: embeddings, scales of the places, bias, classes, their bias, tokens in class, their bias."""

    def __init__(self, params: list[np.ndarray] | None = None):
        rng = np.random.default_rng(SEED)
        self.params = params or [rng.normal(0, 0.3, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in WEIGHTS]
        if params is None:
            self.params[1] += 1
            self.params[6][:] = 0

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        embed, scale, bias = self.params[:3]
        return np.tanh(sum(embed[around[:, k]] * scale[k] for k in range(len(PLACES))) + bias)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        """Over the first axis: numpy reduces that one fast."""
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    @staticmethod
    def _log_share(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Logarithm of the softmax over the first axis, of one row per column."""
        logits -= logits.max(0)
        own = logits[chosen, np.arange(len(chosen))]
        return own - np.log(np.exp(logits, out=logits).sum(0))

    def _classes(self, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each class that occurs, with the rows of its tokens."""
        kind = tokens // CLASSES
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        return ((c, order[bounds[c]:bounds[c + 1]]) for c in range(CLASSES) if bounds[c] < bounds[c + 1])

    def log_probabilities(self, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of every token, given the tokens around it."""
        out = np.empty(len(tokens))
        for i in range(0, len(tokens), BLOCK):
            t, hidden = tokens[i:i + BLOCK], self._hidden(around[i:i + BLOCK])
            own = self._log_share(self.params[3].T @ hidden.T + self.params[4][:, None], t // CLASSES)
            for c, rows in self._classes(t):
                own[rows] += self._log_share(
                    self.params[5][c].T @ hidden[rows].T + self.params[6][c][:, None], t[rows] % CLASSES)
            out[i:i + BLOCK] = own
        return out

    def gradients(self, tokens: np.ndarray, around: np.ndarray) -> list[np.ndarray]:
        """Of the mean of -log_probabilities."""
        embed, scale = self.params[:2]
        hidden, n = self._hidden(around), len(tokens)
        d = self._softmax(self.params[3].T @ hidden.T + self.params[4][:, None])
        d[tokens // CLASSES, np.arange(n)] -= 1
        d /= n
        grads = [np.zeros_like(p) for p in self.params]
        grads[3], grads[4], back = (d @ hidden).T, d.sum(1), d.T @ self.params[3].T
        for c, rows in self._classes(tokens):
            own = hidden[rows]
            inner = self._softmax(self.params[5][c].T @ own.T + self.params[6][c][:, None])
            inner[tokens[rows] % CLASSES, np.arange(len(rows))] -= 1
            inner /= n
            grads[5][c], grads[6][c] = (inner @ own).T, inner.sum(1)
            back[rows] += inner.T @ self.params[5][c].T
        back *= 1 - hidden**2
        grads[2] = back.sum(0)
        for k in range(len(PLACES)):
            grads[1][k] = (back * embed[around[:, k]]).sum(0)
        # Rows of one embedding lie together, then one sum for each.
        flat = around.T.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        place, row = np.divmod(order, n)
        moved = back[row]
        moved *= scale[place]
        grads[0][flat[begin]] = np.add.reduceat(moved, begin)
        return grads


class Trainer:
    """Adam over windows as they come, in steps of BLOCK words."""

    def __init__(self, model: Network):
        self.model, self.words, self.steps, self.waiting, self.held = model, 0, 0, [], 0
        self.m, self.v = ([np.zeros_like(p) for p in model.params] for _ in range(2))

    def _step(self, tokens: np.ndarray, around: np.ndarray) -> None:
        self.steps += 1
        for k, g in enumerate(self.model.gradients(tokens, around)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.model.params[k] = (self.model.params[k] - RATE * (self.m[k] / (1 - 0.9**self.steps)) / (
                np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)

    def add(self, tokens: np.ndarray, around: np.ndarray) -> None:
        self.words += len(tokens)
        self.waiting.append((tokens, around))
        self.held += len(tokens)
        if self.held >= BLOCK:
            tokens, around = (np.concatenate(x) for x in zip(*self.waiting))
            whole = self.held // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._step(tokens[i:i + BLOCK], around[i:i + BLOCK])
            self.waiting, self.held = [(tokens[whole:], around[whole:])], self.held - whole

    def finish(self) -> None:
        if self.held:
            self._step(*(np.concatenate(x) for x in zip(*self.waiting)))
            self.waiting, self.held = [], 0


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Network:
    """The network of a corpus: the mean, weighted with words, of the copies that the tasks train; as initialised without words."""
    model = Network()
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast([p.copy() for p in model.params])   # below 1 MB, whatever the corpus

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Network([p.copy() for p in shared.value]))
            for batch in batches:
                for _, first, hashes in batch_words(batch.column(0).to_pylist()):
                    if len(first):
                        trainer.add(*windows(hashes, first))
            trainer.finish()
            if trainer.words:
                flat = np.concatenate([p.ravel() for p in trainer.model.params]).astype(np.float64) * trainer.words
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat),
                                                  pa.array(np.full(len(flat), trainer.words))], ["weight", "value", "words"])

        found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "weight int, value double, words long")
        mean = found.groupBy("weight").agg((F.sum("value") / F.sum("words")).alias("value")).toArrow()
        if not mean.num_rows:
            return model
        flat = np.empty(mean.num_rows, np.float32)
        flat[mean["weight"].to_numpy()] = mean["value"].to_numpy()
        cuts = np.cumsum([int(np.prod(s)) for s in WEIGHTS])[:-1]
        model = Network([p.reshape(s) for p, s in zip(np.split(flat, cuts), WEIGHTS)])
    return model


def network_scores(docs: DataFrame, model: Network, id_col: str, text_col: str) -> DataFrame:
    """One row per document (chunk NULL) and one per different chunk of it.

    `row` and `check` (hashes of id and text), `id`, `chunk`, `n` (words; of a chunk: how often it stands in the document) and `total`
    (summed log-probability; of a chunk: the mean of its places).
    """
    source = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("row"),
                         F.hash(F.col(f"`{text_col}`"), F.col(f"`{id_col}`")).alias("check"),
                         F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([StructField("row", LongType()), StructField("check", IntegerType()), source.schema["id"],
                         StructField("chunk", LongType()), StructField("n", LongType()), StructField("total", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model.params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = Network(shared.value), schema.names
        for batch in batches:
            row, check = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n, total = np.zeros(len(row), np.int64), np.zeros(len(row))
            for rows, first, hashes in batch_words(batch.column(3).to_pylist()):
                if not len(rows):
                    continue
                logp = own.log_probabilities(*windows(hashes, first))
                total[rows] = np.add.reduceat(logp, first)
                n[rows] = np.diff(np.append(first, len(hashes)))
                begin, value = chunks(hashes, first)
                doc = np.searchsorted(first, begin, "right") - 1
                order = np.lexsort((value, doc))
                doc, value, part = doc[order], value[order], np.add.reduceat(logp, begin)[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
                often = np.diff(np.append(new, len(doc)))
                at = rows[doc[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[at]), pa.array(check[at]), pa.nulls(len(at), batch.column(2).type),
                     pa.array(value[new].view(np.int64)), pa.array(often), pa.array(np.add.reduceat(part, new) / often)], names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.nulls(len(row), pa.int64()),
                                              pa.array(n), pa.array(total)], names)

    return source.mapInArrow(run, schema)


def scores(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_tokens, network_log_likelihood and log_likelihood (with the corpus memory)."""
    rows = saved(network_scores(docs, model, id_col, text_col), "lm-rows")
    pieces = rows.where("chunk IS NOT NULL")
    # Two tables meet, so a chunk that holds a third of all rows is split by adaptive execution.
    common = saved(pieces.groupBy("chunk").agg(F.sum("n").alias("places")).where("places > 1"), "lm-chunks")
    others = F.col("places") - 1
    share = others / (others + PRIOR)
    gain = F.col("n") * (F.log(share + (1 - share) * F.exp("total")) - F.col("total"))
    zero = F.lit(0).cast("bigint")
    parts = rows.where("chunk IS NULL").select(
        "row", "check", "id", F.lit(1).cast("bigint").alias("rows"), "n", "total", F.lit(0.0).alias("gain")).unionByName(
        pieces.join(common, "chunk").select("row", "check", "id", zero.alias("rows"), zero.alias("n"), F.lit(0.0).alias("total"),
                                            gain.alias("gain")))
    # Equal rows share one key and one score; each gets its row back.
    found = parts.groupBy("row", "check").agg(
        F.max("id").alias("id"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("gain").alias("gain"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
    return each.select(F.col("id").alias(id_col), F.call_function("div", "n", F.col("rows")).cast("bigint").alias("n_tokens"),
                       (F.col("total") / F.col("rows")).alias("network_log_likelihood"),
                       ((F.col("total") + F.col("gain")) / F.col("rows")).alias("log_likelihood"))


def document_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, log_likelihood, mean_log_likelihood (NULL without words), network_log_likelihood."""
    rows = scores(docs, train(docs))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"), "network_log_likelihood")
