"""Language-model scores of whole texts by a hashed maximum-entropy model.

Tokens are white-space words and one end per text.  The commonest words and one
outcome for all others are the model's outcomes, in classes of like frequency:
P(outcome | history) = P(class | history) * P(outcome | class, history).  In the last
class a gate first tells the shared outcome from the class's words, so that the many
tokens behind it need no choice among these.  All factors are log-linear in hashed
features of the history: a bias, the word before, the two words before, and the word
before that one (a skip); words are any words of the texts, not outcomes only.  A word
behind the shared outcome has its smoothed share of all such words.  Outcomes and
feature slots grow with the distinct words.

Training is by gradient updates: in each round every task goes once through its
share of the round's texts in small batches, and the tasks' weights are averaged
by how often each task met a slot.  The rounds share all training texts between
them.  Word counts of the whole corpus never leave Spark, but for a bounded table
of the commonest.  A text is worked on alone and whole: a very long one needs
memory in proportion to its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taufold.llm import words as W
from taufold.llm.frequent import most_frequent
from taufold.sources.stage import stage

#: Hashed features of a history beside the bias.
FEATURES = 3
#: Slots for each class; a slot is one row of weights, as wide as there are classes.
SLOTS = 2048
#: Rounds of gradient updates; each is over its own share of the training texts.
ROUNDS = 4
#: Tokens of one gradient update.
BATCH = 8192
#: Weights that are worked on at once, and bytes of text that are hashed at once: what they need stays in cache.
BLOCK_WEIGHTS = 1 << 17
HASHED_BYTES = 1 << 16
#: Summands of a slot's gradient that are added side by side with those of other slots; the few that are left follow one by one.
SIDE_BY_SIDE = 16
RATE = 0.3
#: Exponentials of numbers no further from 0 than this, and sums of them, stay normal in single precision.
SPAN = 40.0
#: Bias of an outcome that is no longer to be chosen.
NEVER = -20.0
#: Weights travel in parts of so many bytes (changes at half precision), summed by SUM_TASKS tasks one after the other.
PART_BYTES = 1 << 15
SUM_TASKS = 8
#: Words of a task that are counted together before they are sent.
COUNTED = 1 << 22
#: Commonest words whose counts are broadcast, at 16 bytes each; counts of other words meet them in a join.
TABLE_WORDS = 1 << 20
END = np.uint64(0x5851F42D4C957F2D)


def _token_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows low:high, the hashes of their tokens in a row, and the first token of each row."""
    data, offsets = W.text_bytes(column)
    for low, high in W.text_slices(offsets):
        own = offsets[low : high + 1]
        parts = [W.find_words(data, own[a : b + 1], W.LOWER) for a, b in W.text_slices(own, HASHED_BYTES)]
        first = np.cumsum(np.concatenate([[0], *(words.counts + 1 for words in parts)]))
        yield low, high, np.concatenate([np.insert(words.hashes, words.first[1:], END) for words in parts]), first


def _totals(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def _counted(slices: Iterator[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for keys in slices:
        held.append(keys)
        n += len(keys)
        if n >= COUNTED:
            key, times = _totals(held)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(times)], names)
            held, n = [], 0
    if n:
        key, times = _totals(held)
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(times)], names)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, c): how often each word's hash, and the end, occurs in all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted((tokens for batch in batches for _, _, tokens, _ in _token_slices(batch.column(0))), ["word", "c"])

    return docs.select(text).mapInArrow(scan, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def side_of(n_words: int) -> int:
    """Classes, and outcomes of each: the fourth root of the distinct words, or up to twice that; a power of two from 16 on.

    The weights are SLOTS * side**2 numbers, so they grow with the square root of the
    words: 2 MB at 60,000, 8 MB at a million, 134 MB at 250 million.  The shared
    outcome is the last; the gate has one number a slot.
    """
    side = 16
    while side**4 < n_words:
        side *= 2
    return side


def outcome_table(head: np.ndarray) -> W.HashTable:
    """Outcomes of the head words, by their place; whatever is not found is the shared outcome."""
    table = W.HashTable(max(4, (2 * len(head)).bit_length()))
    table.add(head, 0)
    return table


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES) hashed features of each token's history inside its text."""
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    starts = first[:-1]
    one[starts] = two[starts] = END
    seconds = starts + 1
    two[seconds[seconds < first[1:]]] = END
    return np.stack([W.mix(one + np.uint64(1)), W.mix(W.mix(two) + one), W.mix(two + np.uint64(2))], axis=1)


def slots(features: np.ndarray, node: np.ndarray, side: int) -> np.ndarray:
    """Rows of the weights for a decision: node 0 picks the class, node 1 + c the outcome inside class c.

    The first ``side + 1`` rows are the nodes' biases.
    """
    hashed = W.mix(features + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
    rest = np.uint64(SLOTS * side - side - 1)
    return np.concatenate([node[:, None], (hashed % rest).astype(np.int64) + side + 1], axis=1)


def _blocks(n: int, side: int) -> Iterator[slice]:
    """Runs of rows of ``side`` numbers that are worked on at once."""
    size = _block_rows(side)
    return (slice(low, min(low + size, n)) for low in range(0, n, size))


def _block_rows(side: int) -> int:
    return max(1, BLOCK_WEIGHTS // side)


def _totals_of(weights: np.ndarray, rows: np.ndarray, total: np.ndarray, room: np.ndarray) -> None:
    """Sums of the rows' weights into ``total``, shifted where their exponentials would overflow or vanish."""
    room, node = room[: len(rows)], rows[:, 0]
    # Without "clip" numpy would fill a copy of ``out`` first; all rows are there.
    weights.take(rows[:, 1], 0, out=total, mode="clip")
    for k in range(2, rows.shape[1]):
        weights.take(rows[:, k], 0, out=room, mode="clip")
        total += room
    total += weights[node[0]] if (node == node[0]).all() else weights.take(node, 0, out=room, mode="clip")
    if total.max(initial=0) > SPAN or total.min(initial=0) < -SPAN:
        total -= total.max(-1, keepdims=True)


def log_chosen(weights: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the chosen outcomes of some decisions."""
    side = weights.shape[1]
    out = np.empty(len(chosen))
    total, room = np.empty((2, min(_block_rows(side), len(chosen)), side), weights.dtype)
    for part in _blocks(len(chosen), side):
        own, at = total[: part.stop - part.start], chosen[part]
        _totals_of(weights, rows[part], own, room)
        out[part] = own[np.arange(len(at)), at]
        np.exp(own, out=own)
        out[part] -= np.log(np.einsum("ij->i", own))
    return out


def _errors_of(weights: np.ndarray, rows: np.ndarray, chosen: np.ndarray, error: np.ndarray, room: np.ndarray) -> None:
    """Probabilities of all outcomes of some decisions less the chosen ones, into ``error``."""
    for part in _blocks(len(chosen), weights.shape[1]):
        own, at = error[part], chosen[part]
        _totals_of(weights, rows[part], own, room)
        np.exp(own, out=own)
        own /= np.einsum("ij->i", own)[:, None]
        own[np.arange(len(at)), at] -= 1


def _segment_sums(values: np.ndarray, at: np.ndarray, first: np.ndarray, times: np.ndarray, out: np.ndarray, room: np.ndarray) -> None:
    """Sums of ``values[at]`` over segments that start at ``first`` and are ``times`` long, the longest first, into ``out``."""
    for k in range(SIDE_BY_SIDE):
        longer = len(times) - int(np.searchsorted(times[::-1], k, "right"))
        for part in _blocks(longer, values.shape[1]):
            more = room[: part.stop - part.start] if k else out[part]
            values.take(at[first[part] + k], 0, out=more, mode="clip")
            if k:
                out[part] += more
    long = np.flatnonzero(times > SIDE_BY_SIDE)
    if len(long):
        sizes = times[long] - SIDE_BY_SIDE
        ends = np.cumsum(sizes)
        left = values.take(at[np.arange(ends[-1]) + np.repeat(first[long] + SIDE_BY_SIDE - ends + sizes, sizes)], 0)
        for j, low, high in zip(long.tolist(), (ends - sizes).tolist(), ends.tolist()):
            out[j] += left[low:high].sum(0)


def _segments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different rows in order, where each begins in ``rows`` sorted, how often it occurs, and the sorted rows' places."""
    bits = np.uint64(max(1, len(rows) - 1).bit_length())
    # Row and place sort as one number, much faster than the places alone by their rows.
    both = (rows.astype(np.uint64) << bits) | np.arange(len(rows), dtype=np.uint64)
    both.sort()
    own = (both >> bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], first, np.diff(np.append(first, len(own))), (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def log_gate(gate: np.ndarray, rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Natural log probabilities that tokens of the last class are the shared outcome, or that they aren't."""
    total = gate[:, 0].take(rows).sum(1, dtype=np.float64)
    return -np.logaddexp(0.0, np.where(shared, -total, total))


def log_probabilities(features: np.ndarray, outcome: np.ndarray, weights: np.ndarray, gate: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each outcome after its history; without ``gate`` the last outcome is like the others."""
    side = weights.shape[1]
    out = np.empty(len(outcome))
    for low in range(0, len(outcome), BATCH):
        own, at, found = (x[low : low + BATCH] for x in (features, outcome, out))
        group, member = np.divmod(at, side)
        rows = slots(own, np.zeros_like(at), side)
        found[:] = log_chosen(weights, rows, group)
        inner = slice(None)
        if gate is not None:
            last, shared = np.flatnonzero(group == side - 1), at == side * side - 1
            found[last] += log_gate(gate, rows.take(last, 0), shared[last])
            inner = np.flatnonzero(~shared)
        found[inner] += log_chosen(weights, slots(own[inner], 1 + group[inner], side), member[inner])
    return out


def _gradient_parts(weights: np.ndarray, rows: np.ndarray, chosen: np.ndarray, pool: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slots that some decisions meet, how often, where in ``pool`` the gradient of each is, and its largest square there.

    A slot that is met once has its decision's error as its gradient, so it is not
    copied; only sums over several decisions are added to the pool.
    """
    n, side = len(chosen), weights.shape[1]
    order = np.argsort(rows[:, 0].astype(np.min_scalar_type(len(weights))), kind="stable")
    rows, chosen = rows.take(order, 0), chosen.take(order)
    _errors_of(weights, rows, chosen, pool[:n], room)
    # Biases come first among the slots, few and often met; the others are many and mostly met once.
    begin = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    slot, first, times, at = _segments(rows[:, 1:].ravel())
    at //= rows.shape[1] - 1
    many = np.flatnonzero(times > 1)
    many = many[np.argsort(-times[many], kind="stable")]
    nodes, end = n + len(begin), n + len(begin) + len(many)
    for j, (low, high) in enumerate(zip(begin, np.append(begin[1:], n))):
        pool[low:high].sum(0, out=pool[n + j])
    _segment_sums(pool[:n], at, first[many], times[many], pool[nodes:end], room)
    # The errors of a decision add up to 0 and only the chosen one is below, so none is larger.
    largest = np.concatenate([pool[np.arange(n), chosen], np.empty(end - n, pool.dtype)])
    for part in _blocks(end - n, side):
        sums = pool[n:end][part]
        largest[n:][part] = np.maximum(sums.max(1), -sums.min(1))
    source = at[first]
    source[many] = np.arange(nodes, end)
    source = np.concatenate([np.arange(n, nodes), source])
    met = np.concatenate([np.diff(np.append(begin, n)), times])
    return np.concatenate([rows[begin, 0], slot]), met, source, np.square(largest).take(source)


def _pool(decisions: int, weights: np.ndarray) -> np.ndarray:
    """Room for the errors of so many decisions and the sums over any of them."""
    return np.empty((decisions + min(decisions, weights.shape[1] + 1) + decisions * FEATURES // 2, weights.shape[1]), weights.dtype)


def gradients(weights: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots that some decisions meet, how often, and the gradient of the negative log likelihood there."""
    pool = _pool(len(chosen), weights)
    row, times, source, _ = _gradient_parts(weights, rows, chosen, pool, np.empty((_block_rows(weights.shape[1]), weights.shape[1]), weights.dtype))
    return row, times, pool.take(source, 0)


class Gate:
    """The gate's weights as one task moves them, by the steps of ``Learner``."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.copy()
        self.squares = np.ones(len(weights), np.float32)
        self.times = np.zeros(len(weights), np.float32)

    def update(self, rows: np.ndarray, shared: np.ndarray) -> None:
        """Move by some tokens of the last class, given whether each is the shared outcome."""
        error = np.exp(log_gate(self.weights, rows, np.ones(len(rows), bool))) - shared
        row, first, times, at = _segments(rows.ravel())
        step = np.add.reduceat(error.take(at // rows.shape[1]), first)
        self.squares[row] += np.square(step)
        self.times[row] += times
        self.weights[row, 0] -= RATE * step / np.sqrt(self.squares[row])


class Learner:
    """Weights that one task moves: steps shrink with the squares of the gradients a slot has seen.

    Without ``gate`` the last outcome is like the others.
    """

    def __init__(self, weights: np.ndarray, gate: np.ndarray | None = None):
        self.weights = weights.copy()
        # A slot's weights as one item: whole items are stored much faster than rows of numbers.
        self.items = self.weights.view(f"V{weights[0].nbytes}").ravel()
        self.squares = np.ones(len(weights), np.float32)
        self.times = np.zeros(len(weights), np.float32)
        self.pool = _pool(BATCH, self.weights)
        self.room = np.empty((2, _block_rows(weights.shape[1]), weights.shape[1]), weights.dtype)
        self.gate = None if gate is None else Gate(gate)

    def learn(self, features: np.ndarray, outcome: np.ndarray) -> None:
        side = self.weights.shape[1]
        for low in range(0, len(outcome), BATCH):
            own, at = features[low : low + BATCH], outcome[low : low + BATCH]
            group, member = np.divmod(at, side)
            rows = slots(own, np.zeros_like(at), side)
            self._update(rows, group)
            inner = slice(None)
            if self.gate is not None:
                last, shared = np.flatnonzero(group == side - 1), at == side * side - 1
                if len(last):
                    self.gate.update(rows.take(last, 0), shared[last])
                inner = np.flatnonzero(~shared)
            if len(group[inner]):
                self._update(slots(own[inner], 1 + group[inner], side), member[inner])

    def _update(self, rows: np.ndarray, chosen: np.ndarray) -> None:
        row, times, source, largest = _gradient_parts(self.weights, rows, chosen, self.pool, self.room[0])
        squares = self.squares[row] + largest
        self.squares[row] = squares
        self.times[row] += times
        rate = (RATE / np.sqrt(squares))[:, None]
        for part in _blocks(len(row), self.weights.shape[1]):
            own, step = self.room[:, : part.stop - part.start]
            self.pool.take(source[part], 0, out=step, mode="clip")
            step *= rate[part]
            self.weights.take(row[part], 0, out=own, mode="clip")
            own -= step
            self.items[row[part]] = own.view(self.items.dtype).ravel()


def start_weights(times: np.ndarray, side: int) -> np.ndarray:
    """Biases from the outcomes' frequencies, zero elsewhere."""
    weights = np.zeros((SLOTS * side, side), np.float32)
    share = np.ones(side * side)
    share[: len(times)] += times
    share = share.reshape(side, side)
    weights[0] = np.log(share.sum(1) / share.sum())
    weights[1 : side + 1] = np.log(share / share.sum(1, keepdims=True))
    return weights


def start_gate(times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The gate's start from the frequencies of all outcomes; the last class's own choice goes on among its words."""
    side = weights.shape[1]
    share = 1.0 + times[-side:]
    words = share[:-1].sum()
    gate = np.zeros((len(weights), 1), np.float32)
    gate[0] = np.log(share[-1] / words)
    weights[side, :-1] = np.log(share[:-1] / words)
    weights[side, -1] = NEVER
    return gate


def tasks_of(n_tokens: int, n_weights: int, cores: int) -> int:
    """Tasks of a round: one for each core, unless that gives a task fewer tokens than it sends weights."""
    return max(1, min(cores, -(-n_tokens // (ROUNDS * n_weights))))


def _parts(weights: np.ndarray, gate: np.ndarray) -> list[tuple[int, slice]]:
    """The parts in which changes travel: which of the two it belongs to, and its slots."""
    sizes = [PART_BYTES // x[0].nbytes for x in (weights, gate)]
    return [(k, slice(low, low + sizes[k])) for k, x in enumerate((weights, gate)) for low in range(0, len(x), sizes[k])]


def _move(weights: np.ndarray, gate: np.ndarray, sums: pa.Table) -> None:
    """Add each block's mean change of the tasks that met its slots."""
    parts = _parts(weights, gate)
    for b, moved, times in zip(sums["block"].to_pylist(), sums["moved"], sums["times"]):
        met = np.maximum(np.frombuffer(times.as_buffer(), np.float32), 1.0)[:, None]
        k, part = parts[b]
        (weights, gate)[k][part] += np.frombuffer(moved.as_buffer(), np.float32).reshape(len(met), -1) / met


def train(training: DataFrame, text: str, head: np.ndarray, times: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SLOTS * side, side) and gate (SLOTS * side, 1) fitted to all training texts; ``times`` counts the side**2 outcomes."""
    spark = training.sparkSession
    weights = start_weights(times, side)
    gate = start_gate(times, weights)
    turn = F.pmod(F.xxhash64(text), F.lit(ROUNDS))
    tasks = tasks_of(int(times.sum()), weights.size, spark.sparkContext.defaultParallelism)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, gate))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, learner = outcome_table(head), None
            for batch in batches:
                for _, _, tokens, first in _token_slices(batch.column(0)):
                    outcome = table.find(tokens).astype(np.int64)
                    outcome[outcome < 0] = side * side - 1
                    learner = learner or Learner(*shared.value)
                    learner.learn(contexts(tokens, first), outcome)
            if learner is None:
                return
            for b, (k, part) in enumerate(_parts(*shared.value)):
                own = (learner, learner.gate)[k]
                times = own.times[part]
                moved = (own.weights[part] - shared.value[k][part]).astype(np.float16)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([moved.tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary())], ["block", "moved", "times"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for b, moved, times in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    times = np.frombuffer(times, np.float32)
                    moved = np.frombuffer(moved, np.float16).astype(np.float32).reshape(len(times), -1) * times[:, None]
                    parts = [moved, times]
                    sums[b] = [x + y for x, y in zip(sums[b], parts)] if b in sums else parts
            for b, parts in sums.items():
                yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "moved", "times"])

        schema = "block int, moved binary, times binary"
        texts = training.filter(F.coalesce(turn, F.lit(0)) == k).select(text).coalesce(tasks)
        # Arrow spares the driver a row object and several copies of each block.
        sums = texts.mapInArrow(learn, schema).repartition(SUM_TASKS, "block").mapInArrow(add, schema).toArrow()
        _move(weights, gate, sums)
        del sums
        shared.destroy()  # its file too
        W.release_memory()
    return weights, gate


def _worker_tables(number: str, words: np.ndarray, weights: np.ndarray) -> tuple[W.HashTable, np.ndarray]:
    """The broadcast words' lookup table and the weights, made once in each worker."""

    def build() -> tuple[W.HashTable, np.ndarray]:
        table = W.HashTable(max(4, (2 * len(words)).bit_length()))
        table.add(words, 0)
        # What numpy allocates stands on large pages, what pickle reads doesn't; rows are read from all over it.
        return table, weights.copy()

    return W.resident(("words", number), build)


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows where ``held_out`` is false or NULL.  Scores are log10
    probabilities of the whole text: ``base_score`` by add-one word frequencies,
    ``score`` by the model.  NULL, empty and wordless texts are the end alone.
    Rows of equal or NULL ids are rows of their own.  Without any training row
    all words are unknown.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    training = docs.filter(~held)
    counts = stage(word_counts(training, text), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = total["n"], total["v"]
    top = most_frequent(counts, "c", TABLE_WORDS).toArrow()
    words, times = (top.column(c).to_numpy().astype(np.int64) for c in (0, 1))
    order = np.lexsort((words, -times))
    words, times = words[order].view(np.uint64), times[order]
    side = side_of(n_words)
    # All other words share one outcome; its smoothed words include one that stands for any unknown.
    other = side * side - 1
    head = words[:other]
    rest_total = n_train - int(times[: len(head)].sum())
    rest_words = n_words - len(head)
    rest_size = float(rest_total + rest_words + 1)
    outcome_times = np.zeros(side * side, np.int64)
    outcome_times[: len(head)], outcome_times[other] = times[: len(head)], rest_total
    weights, gate = train(training, text, head, outcome_times, side)
    shared = spark.sparkContext.broadcast((words, times, weights, gate))
    number = uuid.uuid4().hex  # an address could be used again

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, weights, gate = shared.value
        common, weights = _worker_tables(number, words, weights)
        logs = np.log10(times + 1.0)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, tokens, first in _token_slices(batch.column(1)):
                place = common.find(tokens)
                known = place >= 0
                base = np.zeros(len(tokens))
                base[known] = logs[place[known]]
                # The head comes first among the common words.
                outcome = np.where(known & (place < other), place, other).astype(np.int64)
                score = log_probabilities(contexts(tokens, first), outcome, weights, gate)
                score /= np.log(10.0)
                shares = outcome == other
                score[shares] += base[shares] - np.log10(rest_size)
                rare = np.flatnonzero(~known)
                cuts = np.searchsorted(rare, first).astype(np.int32)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, score)]
                yield pa.record_batch(
                    [
                        pa.array(np.arange(key, key + high - low)),
                        batch.column(0).slice(low, high - low),
                        batch.column(2).slice(low, high - low),
                        pa.array(np.diff(first)),
                        *map(pa.array, sums),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens[rare].view(np.int64))),
                    ],
                    ["key", "id", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )
                key += high - low

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"key long, id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>"
    source = docs.select(F.col(doc_id), F.col(text), held.alias("_held_out"))
    rows = stage(source.mapInArrow(scan, schema), "partial-scores")
    # The rare words' counts; an unknown word adds log10(0 + 1) = 0, so only known ones are needed.
    rare = rows.select("key", F.explode("rare").alias("word")).join(counts, "word")
    found = rare.groupBy("key").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("found"))
    joined = rows.drop("rare").join(found, "key", "left").fillna({"more": 0.0, "found": 0})
    base_size = float(np.log10(n_train + n_words + 1))
    return joined.select(
        F.col("id").alias(doc_id),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("found")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * base_size).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )
