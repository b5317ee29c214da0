"""A gated recurrent language model with a class-factored output, trained and run in numpy.

Words come in three tiers by their counts in all training documents. The first DYNAMIC
words lie in classes, and both the class and the word in it depend on the state; a class has
about sqrt(N / c) words, where c is the count of its first one, which makes the least work
of classes and of words in them (and at most sqrt(DYNAMIC) classes). The rest of the first
HEAD words lie in classes of about equal mass, where the state gives the class and the counts
give the word; all others are one class, in which a word's probability comes from its count
(a half is added, so that words never seen have one too). So the probabilities of all words
sum to one. Words seen once are among the others, where they teach the state when a word
that was never seen comes.

Training is by truncated backpropagation: each task runs Adam over its documents' windows
of STEPS steps, the state goes on from window to window, and the weights of all tasks are
averaged after each of ROUNDS rounds, over one part of the training documents each; every
training document is in one of them. Adam's moments are averaged and go on with the weights,
and a task has at least some TASK tokens, so that scores hardly depend on how the rows are
partitioned. Scoring runs every document from its first word to
its end with one state.

In windows and in scoring, states and gates are held by feature, a column for each token at
work, so that numpy's loops are long. Logits are bounded in a pass of their own only where
the weights don't rule out that one is too large.

Counts beyond the first HEAD words are never broadcast: their words are summed through a
join.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import memory, shingles

HEAD, INPUTS, DYNAMIC, BINS = 131_072, 8192, 8192, 12
HIDDEN, LANES, STEPS, ROUNDS, RATE, TASK = 12, 512, 10, 4, 0.03, 1_000_000
#: Bytes of texts that a worker handles at a time, and tasks whose weights are averaged in one task of the next level.
PART, FAN = 10_000_000, 16
#: Bytes of the longest word that the vocabulary holds as it is; a longer one is held by its digest, so that its size is bounded.
LONGEST = 64
#: Logits are kept under this, so that their exponentials stay finite.
_MOST = np.float32(80)
#: Stands for a document's end among words; white space is in no word.
END = "\n"


def short(words: pa.Array) -> pa.Array:
    """The words, and for those of over LONGEST bytes a tab and their digest; white space is in no word."""
    long = pc.greater(pc.binary_length(words), LONGEST)
    if not pc.any(long).as_py():
        return words
    return pc.replace_with_mask(words, long, pa.array(["\t" + hashlib.sha256(w.encode()).hexdigest() for w in words.filter(long).to_pylist()], words.type))


class Vocabulary:
    """What a worker needs of the counts: the first words, and totals of all."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.total, self.distinct = total, distinct
        n = len(words)
        self.dynamic = min(n, DYNAMIC)
        ends = [0]
        while ends[-1] < self.dynamic:
            ends.append(min(self.dynamic, ends[-1] + max(1, round((total / counts[ends[-1]]) ** 0.5))))
        #: class k of the first words has the ids from ends[k] to ends[k + 1]
        self.ends = np.array(ends, np.int64)
        kinds = len(ends) - 1
        mass = np.cumsum(self.counts[self.dynamic :])
        bins = np.minimum((mass - self.counts[self.dynamic :]) * BINS // max(1, mass[-1] if len(mass) else 1), BINS - 1)
        _, bins = np.unique(bins, return_inverse=True) if len(bins) else (None, bins.astype(np.int64))
        self.classes = kinds + (int(bins.max()) + 1 if len(bins) else 0) + 1
        #: class of each word id; the id n stands for all other words
        self.class_of = np.concatenate([np.repeat(np.arange(kinds), np.diff(self.ends)), kinds + bins, [self.classes - 1]]).astype(np.int64)
        per_class = np.bincount(self.class_of[:n], weights=self.counts, minlength=self.classes)
        #: log10 probability in its class of a word whose class gives it by count; 0 for the others
        self.static = np.zeros(n + 1)
        rest = np.arange(self.dynamic, n)
        self.static[rest] = np.log10(self.counts[rest] / per_class[self.class_of[rest]])
        others, kinds_other = total - int(self.counts.sum()), distinct - n
        #: of all other words together: their total with a half for each and one for those never seen
        self.other_total = others + 0.5 * (kinds_other + 1)
        self.class_mass = per_class + 1e-3
        self.class_mass[-1] += self.other_total
        #: input row of each word id: its own, or its class's
        self.input_of = np.where(np.arange(n + 1) < INPUTS, np.arange(n + 1), min(n, INPUTS) + self.class_of)
        self.inputs = min(n, INPUTS) + self.classes
        self.log_counts = np.append(np.log10(self.counts + 0.5), 0.0)
        self.end = words.index(END) if END in words else n

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(id of each token with each text's end, offsets, distinct words, word code of each token or -1 for an end)."""
        words, codes, offsets = shingles.coded_words(texts)
        of = pc.fill_null(pc.index_in(short(words), value_set=pa.array(self.words, pa.string())), len(self.words)).to_numpy().astype(np.int64)
        n = len(offsets) - 1
        ids = np.insert(of[codes] if len(codes) else codes.astype(np.int64), offsets[1:], self.end)
        codes = np.insert(codes, offsets[1:], -1)
        return ids, offsets + np.arange(n + 1), words, codes


class Model:
    """The weights, by name, and what is done with them."""

    def __init__(self, voc: Vocabulary, blob: bytes | None = None):
        self.voc = voc
        if blob is not None:
            self.w = dict(np.load(io.BytesIO(blob)))
            return
        rng = np.random.default_rng(7)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        first = slice(0, voc.dynamic)
        self.w = {
            "embed": small(voc.inputs, HIDDEN), "wx": small(HIDDEN, 3 * HIDDEN), "wh": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "wc": small(HIDDEN, voc.classes), "bc": np.log(voc.class_mass / voc.class_mass.sum()).astype(np.float32),
            "wo": small(voc.dynamic, HIDDEN), "bo": np.log(voc.counts[first] / voc.class_mass[voc.class_of[first]]).astype(np.float32),
        }

    def blob(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The positions of tokens that are first words, by class, and for each class that has one its words and its part of these positions."""
        kinds = len(self.voc.ends) - 1
        at = np.flatnonzero(ids < self.voc.dynamic)
        c = self.voc.class_of[ids[at]]
        at = at[np.argsort(c.astype(np.uint16), kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=kinds))]).tolist()
        words = self.voc.ends.tolist()
        return at, [(slice(words[k], words[k + 1]), slice(ends[k], ends[k + 1])) for k in range(kinds) if ends[k] < ends[k + 1]]

    def outputs(self, reach: float) -> tuple[np.ndarray, np.ndarray, bool, bool]:
        """Weights of classes and of words with their biases as the last column, and whether logits of states up to reach can pass _MOST, for each."""
        w = self.w
        both = [np.concatenate([w["wc"].T, w["bc"][:, None]], axis=1), np.concatenate([w["wo"], w["bo"][:, None]], axis=1)]
        return *both, *(not (np.abs(x[:, :-1]).sum(axis=1) * np.float32(reach) + x[:, -1]).max(initial=0) <= _MOST for x in both)

    def log10(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each token given its state; of the class alone for a token outside the first words."""
        return self._log10(np.concatenate([h.T, np.ones((1, len(h)), np.float32)]), ids, self.outputs(np.abs(h).max(initial=0)))

    def _log10(self, states: np.ndarray, ids: np.ndarray, outputs: tuple, together: int = 4096) -> np.ndarray:
        """log10 for states as columns that end with a one."""
        by_class, by_word, clip_class, clip_word = outputs
        n, classes = len(ids), self.voc.class_of[ids]
        count, ones = np.arange(n), np.ones(max(by_class.shape[0], int(np.diff(self.voc.ends).max(initial=0))), np.float32)
        out, total = np.empty(n, np.float32), np.empty(n, np.float32)
        for a in range(0, n, together):
            k = slice(a, a + together)
            logits = by_class @ states[:, k]
            if clip_class:
                np.minimum(logits, _MOST, out=logits)
            out[k] = logits[classes[k], count[: logits.shape[1]]]
            total[k] = ones[: len(logits)] @ np.exp(logits, out=logits)
        out = out - np.log(total).astype(np.float64)
        at, parts = self._by_class(ids)
        held, words = states[:, at], ids[at]
        chosen, total = np.empty(len(at), np.float32), np.empty(len(at), np.float32)
        for k, own in parts:
            logits = by_word[k] @ held[:, own]
            if clip_word:
                np.minimum(logits, _MOST, out=logits)
            chosen[own] = logits[words[own] - k.start, count[: logits.shape[1]]]
            total[own] = ones[: len(logits)] @ np.exp(logits, out=logits)
        out[at] += chosen - np.log(total)
        return out / np.log(10) + self.voc.static[ids]

    def score(self, ids: np.ndarray, offsets: np.ndarray, together: int = 32_768) -> np.ndarray:
        """log10 probability of each document; the state is carried through all of it."""
        w, n, H = self.w, len(offsets) - 1, HIDDEN
        # half of what the gates get, as their tanh needs; states, gates and weights are held by feature
        half = np.float32(0.5)
        scale = np.repeat(np.array([half, 1], np.float32), [2 * H, H])[:, None]
        rows, wh = np.ascontiguousarray((w["embed"] @ w["wx"] + w["b"]).T) * scale, np.ascontiguousarray(w["wh"].T) * scale
        outputs = self.outputs(1)
        # tokens by step, and in a step by document, those of most tokens first
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        active = n - np.cumsum(np.bincount(lengths, minlength=1))[:-1]  # documents with more than t tokens
        begins = np.cumsum(active) - active
        doc = np.repeat(np.arange(n), lengths)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = begins[step] + doc
        tokens, whose = np.empty(len(doc), ids.dtype), np.empty(len(doc), np.int32)
        tokens[place], whose[place] = ids[np.repeat(offsets[:-1][order], lengths) + step], doc
        del doc, step, place
        inputs = self.voc.input_of[tokens]
        total, last = np.zeros(n), np.full(n, self.voc.input_of[self.voc.end])
        states = np.ones((H + 1, together + n), np.float32)
        h, held, done = np.zeros((H, n), np.float32), 0, 0
        for begin, k in zip(begins.tolist(), active.tolist()):
            x = rows.take(last[:k], axis=1)
            h = h[:, :k]
            g = wh @ h
            zr, new = x[: 2 * H], x[2 * H :]
            zr += g[: 2 * H]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            g = g[2 * H :]
            g *= zr[H:]
            new += g
            np.tanh(new, out=new)
            h = h - new
            h *= zr[:H]
            h += new
            states[:H, held : held + k] = h
            held += k
            last = inputs[begin : begin + k]
            if held >= together or done + held == len(tokens):
                own = slice(done, done + held)
                total += np.bincount(whose[own], weights=self._log10(states[:, :held], tokens[own], outputs), minlength=n)
                done, held = done + held, 0
        out = np.empty(n)
        out[order] = total
        return out


class Trainer:
    """Adam over windows of many lanes."""

    def __init__(self, model: Model, rate: float = RATE, state: bytes | None = None):
        self.model, self.rate, self.t = model, rate, 0.0
        self.m = {k: np.zeros_like(v) for k, v in model.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.w.items()}
        if state is not None:
            got = np.load(io.BytesIO(state))
            self.t = float(got["t"])
            for k in model.w:
                model.w[k], self.m[k], self.v[k] = got["w_" + k], got["m_" + k], got["v_" + k]

    def state(self) -> bytes:
        """Weights, moments and steps, to go on from."""
        out = io.BytesIO()
        np.savez(out, t=np.float32(self.t), **{f"{a}_{k}": x for a, d in (("w", self.model.w), ("m", self.m), ("v", self.v)) for k, x in d.items()})
        return out.getvalue()

    def _adam(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        m, v = self.m[name][rows], self.v[name][rows]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        square = grad * grad
        square *= 0.01
        v += square
        root = np.sqrt(v, out=square)
        root += 1e-6
        move = np.divide(m, root, out=root)
        move *= self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        self.model.w[name][rows] -= move
        if not isinstance(rows, slice):  # m and v are copies
            self.m[name][rows], self.v[name][rows] = m, v

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step on a window: x, y and fresh (the state starts anew) are steps x lanes; returns the state (lanes x HIDDEN) to go on with."""
        w, voc = self.model.w, self.model.voc
        steps, lanes = x.shape
        H, half, n = HIDDEN, np.float32(0.5), steps * lanes
        rows = voc.input_of[x.ravel()]
        # all is held by feature: a column is a lane's at a step
        emb = np.ascontiguousarray(w["embed"][rows].T)
        gates = w["wx"].T @ emb
        gates += w["b"][:, None]
        go_on = (~fresh).astype(np.float32)
        prev, gn, made = np.empty((H, n), np.float32), np.empty((H, n), np.float32), np.ones((H + 1, n), np.float32)
        h, wh_t = h.T, np.ascontiguousarray(w["wh"].T)
        for t in range(steps):
            at = slice(t * lanes, (t + 1) * lanes)
            h = np.multiply(h, go_on[t], out=prev[:, at])
            g = wh_t @ h
            zr, cand = gates[: 2 * H, at], gates[2 * H :, at]
            zr += g[: 2 * H]
            zr *= half
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            gn[:, at] = g[2 * H :]
            cand += zr[H:] * g[2 * H :]
            np.tanh(cand, out=cand)
            now = made[:H, at]
            np.subtract(h, cand, out=now)
            now *= zr[:H]
            now += cand
            h = now
        ids, part = y.ravel(), np.float32(1 / n)
        by_class, by_word, clip_class, clip_word = self.model.outputs(np.abs(made).max())
        count, ones = np.arange(n), np.ones(max(len(by_class), int(np.diff(voc.ends).max(initial=0))), np.float32)
        classes = voc.class_of[ids]
        d_out, d_class = np.empty((H, n), np.float32), np.zeros(by_class.shape, np.float32)
        for a in range(0, n, 1024):
            k = slice(a, a + 1024)
            p = by_class @ made[:, k]
            if clip_class:
                np.minimum(p, _MOST, out=p)
            np.exp(p, out=p)
            p *= 1 / (ones[: len(p)] @ p)
            p[classes[k], count[: p.shape[1]]] -= 1
            d_out[:, k] = w["wc"] @ p
            d_class += p @ made[:, k].T
        d_class *= part
        d_word = np.zeros(by_word.shape, np.float32)
        at, parts = self.model._by_class(ids)
        held, words, d_held = made[:, at], ids[at], np.empty((H, len(at)), np.float32)
        for k, own in parts:
            ho = held[:, own]
            q = by_word[k] @ ho
            if clip_word:
                np.minimum(q, _MOST, out=q)
            np.exp(q, out=q)
            q *= 1 / (ones[: len(q)] @ q)
            q[words[own] - k.start, count[: q.shape[1]]] -= 1
            d_word[k] = q @ ho.T
            d_held[:, own] = w["wo"][k].T @ q
        d_word *= part
        d_out[:, at] += d_held
        d_out *= part
        dg, dx = np.empty((3 * H, n), np.float32), np.empty((3 * H, n), np.float32)
        # what the gates' slopes take from the state's, for all steps at once
        z, r, cand = gates[:H], gates[H : 2 * H], gates[2 * H :]
        to_z, to_n, to_r = (prev - cand) * z * (1 - z), (1 - z) * (1 - cand * cand), gn * r * (1 - r)
        dh = np.zeros((H, lanes), np.float32)
        for t in reversed(range(steps)):
            at = slice(t * lanes, (t + 1) * lanes)
            dh += d_out[:, at]
            np.multiply(dh, to_z[:, at], out=dx[:H, at])
            dn = np.multiply(dh, to_n[:, at], out=dx[2 * H :, at])
            np.multiply(dn, to_r[:, at], out=dx[H : 2 * H, at])
            dg[: 2 * H, at] = dx[: 2 * H, at]
            np.multiply(dn, r[:, at], out=dg[2 * H :, at])
            dh *= z[:, at]
            dh += w["wh"] @ dg[:, at]
            dh *= go_on[t]
        grads = {
            "wc": d_class[:, :H].T, "bc": d_class[:, H], "wo": d_word[:, :H], "bo": d_word[:, H],
            "wh": prev @ dg.T, "wx": emb @ dx.T, "b": dx.sum(axis=1),
        }
        d_emb = dx.T @ w["wx"].T
        self.t += 1
        order = np.argsort(rows.astype(np.uint16) if voc.inputs <= 1 << 16 else rows, kind="stable")
        firsts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        self._adam("embed", np.add.reduceat(d_emb[order], firsts), rows[order][firsts])
        for name, grad in grads.items():
            self._adam(name, grad)
        return h.T

    def run(self, ids: np.ndarray, offsets: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> None:
        """One pass over documents, laid end to end over the lanes; none is left out."""
        total = len(ids)
        if not total:
            return
        lanes = max(1, min(lanes, total // (100 * steps) + 1))
        wide = -(-total // lanes)
        fresh = np.zeros(total, bool)
        fresh[offsets[:-1]] = True
        x = np.concatenate([[self.model.voc.end], ids[:-1]])
        pad = wide * lanes - total  # the last lane is filled with the first tokens
        x, y, fresh = (np.resize(np.concatenate([a, a[:pad]]), (lanes, wide)).T for a in (x, ids, fresh))
        fresh = fresh.copy()
        fresh[0] = True
        h = np.zeros((lanes, HIDDEN), np.float32)
        for a in range(0, wide, steps):
            h = self.window(x[a : a + steps], y[a : a + steps], fresh[a : a + steps], h)


def held_out(doc_id) -> object:
    """Whether crc32 of the id as text has the remainder 1 by 5; a row without an id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all docs, with a count for the end of each."""

    @memory.lean
    def count(batches):
        for texts in (x for batch in batches for x in shingles.slices(batch.column(0), PART)):
            words, codes, offsets = shingles.coded_words(texts)
            counts = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
            there = np.flatnonzero(counts)
            word = pa.concat_arrays([words.take(pa.array(there)), pa.array([END], pa.string())])
            yield pa.RecordBatch.from_arrays([word, pa.array(np.append(counts[there], len(offsets) - 1).astype(np.int64))], ["word", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a materialized table of counts; the first words are at most HEAD, and occur more than once."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    held = F.when(F.octet_length("word") <= LONGEST, F.col("word")).otherwise(F.concat(F.lit("\t"), F.sha2(F.col("word").cast("binary"), 256)))
    may = counts.where("c > 1").select(held.alias("word"), "c", F.floor(F.log2("c") * 16).cast("int").alias("bin"))
    # the least count that at most HEAD words reach, by bins of a sixteenth of an octave: a thousand rows at most
    least, size = 1 << 30, 0
    for r in sorted(may.groupBy("bin").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bin"]):
        size += r["n"]
        if size > HEAD:
            break
        least = r["bin"]
    first = sorted(may.where(F.col("bin") >= least).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))  # HEAD rows at most
    return Vocabulary([r["word"] for r in first], [r["c"] for r in first], total["n"], total["v"])


def train(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model after one pass over docs (doc_id, text), in as many parts as rounds."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(voc)
    state = Trainer(Model(voc)).state()

    def merge(batches):
        from pyspark import TaskContext

        total, size = None, 0
        for batch in batches:
            for blob, n in zip(batch.column("weights").to_pylist(), batch.column("tokens").to_pylist()):
                w = {k: v.astype(np.float64) * n for k, v in np.load(io.BytesIO(blob)).items()}
                total = w if total is None else {k: total[k] + w[k] for k in w}
                size += n
        if size:
            out = io.BytesIO()
            np.savez(out, **{k: (v / size).astype(np.float32) for k, v in total.items()})
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "weights": [out.getvalue()], "tokens": [size]})

    tasks = min(docs.rdd.getNumPartitions(), max(1, voc.total // TASK))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for k in range(rounds):
        now = spark.sparkContext.broadcast(state)

        @memory.lean
        def fit(batches, now=now):
            from pyspark import TaskContext

            own, seen = None, 0
            for texts in (x for batch in batches for x in shingles.slices(batch.column(0), PART)):
                if own is None:
                    own = Trainer(Model(shared.value), state=now.value)
                ids, offsets, _, _ = shared.value.ids(texts)
                own.run(ids, offsets)
                seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "weights": [own.state()], "tokens": [seen]})

        schema = "node long, weights binary, tokens long"
        fitted, n = docs.where(part == k).select(F.col("text").cast("string")).coalesce(tasks).mapInArrow(fit, schema), tasks
        while n > 1:  # a tree, so that no task and not the driver gets the weights of all
            n = -(-n // FAN)
            fitted = fitted.repartition(n, "node").mapInArrow(merge, schema)
        got = fitted.select("weights").collect()  # one row, or none
        if got:
            state = bytes(got[0]["weights"])
        now.destroy()
    shared.destroy()
    return Trainer(Model(voc), state=state).model


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double)."""
    spark = docs.sparkSession
    voc = model.voc
    shared, weights = spark.sparkContext.broadcast(voc), spark.sparkContext.broadcast(model.blob())
    names = ["row", "doc_id", "n_tokens", "n_other", "head_log", "model_log", "word", "times"]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_other", pa.int64()), ("head_log", pa.float64()), ("model_log", pa.float64()), ("word", pa.string()), ("times", pa.int64())])

    @memory.lean
    def run(batches):
        from pyspark import TaskContext

        own = Model(shared.value, weights.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for texts in shingles.slices(batch.column(1), PART):
                yield from scored(own, row, batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)
                row += len(texts)

    def scored(own, row, keys, texts):
        v = own.voc
        ids, offsets, words, codes = v.ids(texts)
        n, other = len(texts), ids == len(v.words)
        doc_of = np.repeat(np.arange(n), np.diff(offsets))
        head = np.bincount(doc_of, weights=v.log_counts[ids], minlength=n)
        others = np.bincount(doc_of, weights=other, minlength=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), keys, pa.array(np.diff(offsets)), pa.array(others), pa.array(head), pa.array(own.score(ids, offsets)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
        at = np.flatnonzero(other & (codes >= 0))
        key, times = np.unique(doc_of[at] * max(1, len(words)) + codes[at], return_counts=True)
        for lo in range(0, len(key), 100_000):
            some = key[lo : lo + 100_000]
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(row + some // len(words)), *[pa.nulls(m, schema.field(c).type) for c in names[1:6]], words.take(pa.array(some % len(words))), pa.array(times[lo : lo + m])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    made = storage.materialize(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_other long, head_log double, model_log double, word string, times long"), "scored")
    shared.destroy()
    weights.destroy()
    rare = made.where("word IS NOT NULL").select("row", "word", "times").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    out = made.where("word IS NULL").drop("word", "times").join(rare, "row", "left")
    end_rare = F.lit(0.0) if voc.end < len(voc.words) or not voc.total else F.log10(F.lit(0.5))
    rare_log = F.coalesce("rare_log", F.lit(0.0)) + end_rare
    if not voc.total:  # nothing was learnt: every token is unseen
        rare_log = F.col("n_other") * F.log10(F.lit(0.5))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - F.col("n_other") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(float(np.log10(voc.total + 0.5 * (voc.distinct + 1))))).alias("base_score"),
        (F.col("model_log") + rare_log - F.col("n_other") * F.lit(float(np.log10(voc.other_total)))).alias("score"),
    )


def language_scores(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and scores all rows of docs (doc_id, text).

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score
    (double). A null text counts as empty: its only token is the end. Repeated rows are each
    scored. Without training rows every token is unseen and has a probability of one in
    both scores. An empty table gives no rows.
    """
    training = docs.where(~held_out(F.col("doc_id").cast("long")))
    counts = storage.materialize(word_counts(training), "word-counts")
    return score(docs, counts, train(training, vocabulary(counts)))


def op7_gru_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's log-likelihood."""
    return language_scores(storage.table(spark, sf_dir, "documents"))
