"""Language identification by a linear-chain conditional random field.

The chain labels every word of a text with a language, so text that switches
between languages is followed word by word. Words are described by character
n-grams, affixes and a lexicon; the transitions between labels are learned.
Forward-backward gives each word's chances, and a text's language is the one
that most of its words' chances go to; the score is its share.

The model is fitted on a bounded sample: RUNS_PER_SLICE documents in each of
SLICES hash slices of a language, cut into runs of words. Runs of different
languages are also joined, so that switches are seen.

Defined results: null text and text without a letter are ``und`` with score 0,
as is everything when there is no labelled text; null languages are not
learned; rows that repeat are labelled each; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from routewright.llm.common import coded, fold, hash_words, seeded, slices, words_of

UNKNOWN = "und"
HELD_OUT = 0
# Bounds of the sample: documents per language and slice, slices, words of a run, runs of a language.
DOCS_PER_SLICE, SLICES, RUN_WORDS, RUNS = 5, 64, 32, 1200
# Places of the hashed weights.
BUCKETS = 1 << 18
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.25, 1e-4
# Chance that a run is followed by one of another language.
SWITCH = 0.25
# A word is in a language's lexicon at so many uses and such a share of all.
LEXICON_USES, LEXICON_SHARE = 3, 0.9
# Words that are scanned as one block.
SPAN = 32
# A text stays in a pipeline if its words speak for some language at least this much
# against the rest, as a share of what the middle training run's words do.
LEAST_EVIDENCE = 0.25
# Bytes of text that are scanned at once.
AT_ONCE = 1 << 20

_BREAK = 10
_ODD = seeded(21, 8) | np.uint64(1)


@dataclass
class Chain:
    """Languages, hashed word weights, lexicon, transitions and first-word weights."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_language: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    # Middle evidence of the training runs.
    evidence: float = 0.0


def _place(kind: int, code: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return ((code + np.uint64(kind)) * _ODD[kind] >> shift).astype(np.int64)


def features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, weight place) of each n-gram and affix of the words.

    A break before and after each word makes its n-grams tell affixes from
    inner parts; of four bytes only affixes are taken.
    """
    raw = ("\n" + "\n".join(distinct) + "\n").encode()
    s = np.frombuffer(raw, dtype=np.uint8)
    edge = s == _BREAK
    owner = np.cumsum(edge) - 1
    own, place = [], []
    code = s.astype(np.uint64)
    for n in (1, 2, 3, 4):
        if n > 1:
            code = code[:-1] << np.uint64(8) | s[n - 1 :]
        at = np.arange(len(code))
        inner = np.zeros(len(code), dtype=bool)
        for j in range(1, n - 1):
            inner |= edge[at + j]
        left, right = edge[: len(code)], edge[n - 1 :]
        if n == 1:
            keep = ~left
        elif n < 4:
            keep = ~inner & ~(left & right) if n == 2 else ~inner
        else:
            keep = ~inner & (left | right)
        who = np.where(left, owner[: len(code)], owner[at + (n > 1)])
        who = np.where(edge[at + min(1, n - 1)] & ~left, owner[: len(code)], who)
        own.append(who[keep])
        place.append(_place(n, code[keep]))
    return np.concatenate(own), np.concatenate(place)


def _lexicon_places(hashes: np.ndarray, lexicon: np.ndarray, language: np.ndarray):
    """(word number, weight place) of the words that a lexicon holds."""
    if not len(lexicon):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    known = np.flatnonzero(lexicon[at] == hashes)
    return known, _place(6, language[at[known]].astype(np.uint64))


def _sums(own: np.ndarray, place: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.stack(
        [np.bincount(own, weights=weights[place, k], minlength=n) for k in range(weights.shape[1])],
        axis=1,
    )


def emissions(chain: Chain, distinct: list[str]) -> np.ndarray:
    """Weight of each language for each word."""
    own, place = features(distinct)
    more_own, more = _lexicon_places(hash_words(distinct), chain.lexicon, chain.lexicon_language)
    return _sums(
        np.concatenate([own, more_own]), np.concatenate([place, more]), chain.weights, len(distinct)
    )


def evidence(at: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """How far each text's words speak for one language against the mean of all, per word.

    Weights of n-grams that were not learned are 0 or speak against each other,
    so this is small for other scripts and for random letters, however many
    languages there are.
    """
    margin = np.concatenate([[0.0], np.cumsum(emit.max(axis=1) - emit.mean(axis=1))])
    return (margin[at[1:]] - margin[at[:-1]]) / np.maximum(1, np.diff(at))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def fit(runs: list[str], languages: list[str]) -> Chain | None:
    """Learn a chain from runs of words with their languages, by stochastic gradients."""
    names = sorted(set(languages))
    if not names:
        return None
    k = len(names)
    label = np.array([names.index(x) for x in languages])
    at, words = words_of(pc.utf8_lower(pa.array(runs, pa.string())))
    code, distinct = coded(words)
    rng = np.random.default_rng(5)

    # The lexicon: words that are nearly always in one language.
    uses = np.zeros((len(distinct), k))
    np.add.at(uses, (code, np.repeat(label, np.diff(at))), 1)
    share = uses / np.maximum(uses.sum(axis=0), 1)
    sure = (uses.max(axis=1) >= LEXICON_USES) & (
        share.max(axis=1) >= LEXICON_SHARE * share.sum(axis=1)
    )
    hashes = hash_words(distinct)
    order = np.argsort(hashes[sure])
    chain = Chain(
        names,
        np.zeros((BUCKETS, k)),
        hashes[sure][order],
        share.argmax(axis=1)[sure][order].astype(np.int64),
        np.zeros((k, k)),
        np.zeros(k),
    )
    own, place = features(distinct)
    more_own, more = _lexicon_places(hashes, chain.lexicon, chain.lexicon_language)
    own, place = np.concatenate([own, more_own]), np.concatenate([place, more])
    order = np.argsort(own, kind="stable")
    place, ends = place[order], np.searchsorted(own[order], np.arange(len(distinct) + 1))

    seen = [np.full(x.shape, 1e-6) for x in (chain.weights, chain.moves, chain.first)]
    for _ in range(EPOCHS):
        other = rng.permutation(len(label))
        same = np.arange(len(label))[rng.permutation(len(label))]
        for a in range(0, len(label), BATCH):
            lead = same[a : a + BATCH]
            follow = np.where(rng.random(len(lead)) < SWITCH, other[a : a + BATCH], lead)
            tokens, truth = [], []
            for x, y in zip(lead, follow, strict=True):
                parts = [x] if x == y else [x, y]
                tokens.append(np.concatenate([code[at[p] : at[p + 1]] for p in parts]))
                truth.append(np.concatenate([np.full(at[p + 1] - at[p], label[p]) for p in parts]))
            _step(chain, seen, tokens, truth, place, ends)
    chain.weights = chain.weights.astype(np.float32)
    chain.evidence = float(np.median(evidence(at, emissions(chain, distinct)[code])))
    return chain


def _step(chain: Chain, seen: list, tokens: list, truth: list, place, ends) -> None:
    """One gradient of the log chance of the true labels."""
    k = len(chain.languages)
    some, back = np.unique(np.concatenate(tokens), return_inverse=True)
    n = ends[some + 1] - ends[some]
    starts = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(len(some)), n)
    where = place[np.repeat(ends[some] - starts[:-1], n) + np.arange(starts[-1])]
    emit = _sums(own, where, chain.weights, len(some))[back]
    longest = max(map(len, tokens))
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    index = np.minimum(at[:-1, None] + np.arange(longest), max(0, at[-1] - 1))
    valid = np.arange(longest) < np.diff(at)[:, None]
    gold = np.concatenate(truth)[index]
    alpha, beta, local, moves = _forward_backward(chain, emit[index], valid)
    gamma = _scaled(alpha * beta) * valid[..., None]
    error = gamma - np.eye(k)[gold] * valid[..., None]
    by_word = np.zeros((len(some), k))
    np.add.at(by_word, back[index[valid]], error[valid])
    grads = [np.zeros_like(chain.weights), np.zeros_like(chain.moves), error[:, 0].sum(axis=0)]
    touched, inverse = np.unique(where, return_inverse=True)
    gradient = _sums(inverse, own, by_word, len(touched))
    for t in range(1, longest):
        both = alpha[:, t - 1, :, None] * moves[None] * (local[:, t] * beta[:, t])[:, None, :]
        both *= (valid[:, t] / both.sum(axis=(1, 2)))[:, None, None]
        grads[1] += both.sum(axis=0)
        np.add.at(grads[1], (gold[valid[:, t], t - 1], gold[valid[:, t], t]), -1)
    gradient += DECAY * chain.weights[touched]
    seen[0][touched] += gradient**2
    chain.weights[touched] -= RATE * gradient / np.sqrt(seen[0][touched])
    for x, g, s in ((chain.moves, grads[1], seen[1]), (chain.first, grads[2], seen[2])):
        g = g + DECAY * x
        s += g**2
        x -= RATE * g / np.sqrt(s)


def _forward_backward(chain: Chain, emit: np.ndarray, valid: np.ndarray):
    """Scaled alpha and beta of (sequence, word, language) weights, with the local terms."""
    local = np.exp(emit - emit.max(axis=2, keepdims=True))
    moves = np.exp(chain.moves)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    alpha[:, 0] = _scaled(np.exp(chain.first) * local[:, 0])
    for t in range(1, local.shape[1]):
        alpha[:, t] = _scaled(alpha[:, t - 1] @ moves * local[:, t])
        alpha[:, t] = np.where(valid[:, t, None], alpha[:, t], alpha[:, t - 1])
    for t in range(local.shape[1] - 2, -1, -1):
        beta[:, t] = _scaled((local[:, t + 1] * beta[:, t + 1]) @ moves.T)
        beta[:, t] = np.where(valid[:, t + 1, None], beta[:, t], 1.0)
    return alpha, beta, local, moves


def shares(chain: Chain, at: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Mean chance of each language over the words of each text; exact for any length.

    Texts are cut into spans. The spans' transfer matrices carry the forward and
    backward chances along a text, so all spans are scanned at once.
    """
    k, n_texts = len(chain.languages), len(at) - 1
    out = np.zeros((n_texts, k))
    size = np.diff(at)
    if not size.sum():
        return out
    spans = -(-size // SPAN)
    first_span = np.concatenate([[0], np.cumsum(spans)])
    text = np.repeat(np.arange(n_texts), spans)
    nth = np.arange(first_span[-1]) - first_span[text]
    start = at[text] + nth * SPAN
    length = np.minimum(SPAN, at[text + 1] - start)
    index = np.minimum(start[:, None] + np.arange(SPAN), len(emit) - 1)
    valid = (np.arange(SPAN) < length[:, None])[..., None]
    local = np.exp(emit - emit.max(axis=1, keepdims=True))[index]
    moves = np.exp(chain.moves)
    moves /= moves.max()
    # Word t's matrix is the move into it, but for a text's first word.
    begins = nth == 0
    transfer = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for t in range(SPAN):
        step = (transfer.reshape(-1, k) @ moves).reshape(-1, k, k)
        if t == 0:
            step = np.where(begins[:, None, None], transfer, step)
        step = step * local[:, t, None, :]
        transfer = np.where(valid[:, t, None], step, transfer)
        transfer /= transfer.max(axis=(1, 2), keepdims=True)
    into, onward = np.empty((len(start), k)), np.empty((len(start), k))
    has = np.flatnonzero(spans)
    into[first_span[has]] = _scaled(np.exp(chain.first))
    onward[first_span[has + 1] - 1] = 1 / k
    for j in range(1, spans.max()):
        go = has[spans[has] > j]
        ahead = first_span[go] + j
        into[ahead] = _scaled(np.einsum("ni,nij->nj", into[ahead - 1], transfer[ahead - 1]))
        behind = first_span[go + 1] - 1 - j
        onward[behind] = _scaled(np.einsum("nij,nj->ni", transfer[behind + 1], onward[behind + 1]))
    alpha = np.empty((SPAN, len(start), k))
    now = into
    for t in range(SPAN):
        step = now @ moves
        if t == 0:
            step = np.where(begins[:, None], now, step)
        now = np.where(valid[:, t], _scaled(step * local[:, t]), now)
        alpha[t] = now
    total, now = np.zeros((len(start), k)), onward
    for t in range(SPAN - 1, -1, -1):
        total += np.where(valid[:, t], _scaled(alpha[t] * now), 0.0)
        back = _scaled((local[:, t] * now) @ moves.T)
        now = np.where(valid[:, t], back, now)
    by_text = np.add.reduceat(total, first_span[has], axis=0)
    out[has] = by_text / size[has, None]
    return out


def training_runs(docs: DataFrame) -> DataFrame:
    """(lang, run): the bounded sample, from documents that may be learned from."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(
        (fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    order = F.xxhash64(F.lit(7), "doc_id")
    ids = rows.select("lang", "doc_id", order.alias("order"))
    slot = Window.partitionBy("lang", F.pmod("order", F.lit(SLICES))).orderBy("order", "doc_id")
    drawn = (
        ids.withColumn("nth", F.row_number().over(slot))
        .where(F.col("nth") <= DOCS_PER_SLICE)
        .select("lang", "doc_id")
        .distinct()
    )
    words = F.split("text", r"[\x20\x09-\x0D]+")
    numbers = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / RUN_WORDS).cast("int"))
    runs = (
        rows.join(F.broadcast(drawn), ["lang", "doc_id"])
        .select("lang", "doc_id", words.alias("words"))
        .select("lang", "doc_id", "words", F.explode(numbers).alias("i"))
        .select(
            "lang",
            F.array_join(F.slice("words", F.col("i") * RUN_WORDS + 1, RUN_WORDS), " ").alias("run"),
            F.xxhash64(F.lit(8), "doc_id", "i").alias("order"),
        )
    )
    best = Window.partitionBy("lang").orderBy("order", "run")
    return runs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= RUNS)


def learn(docs: DataFrame) -> Chain | None:
    sample = sorted((r.lang, r.nth, r.run) for r in training_runs(docs).collect())
    return fit([s[2] for s in sample], [s[0] for s in sample])


def predict(chain: Chain | None, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share, and evidence relative to the training runs, of each text."""
    names, score, told = [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text))
    if chain is not None:
        at, words = words_of(pc.utf8_lower(text), lower=False)
        code, distinct = coded(words)
        weights = emissions(chain, distinct)[code]
        found = shares(chain, at, weights)
        told = evidence(at, weights) / max(chain.evidence, 1e-9)
        letter = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False)
        for i in np.flatnonzero(letter.to_numpy(zero_copy_only=False)):
            best = int(found[i].argmax())
            names[i], score[i] = chain.languages[best], min(1.0, found[i, best])
    return names, score, told


def identify(docs: DataFrame, chain: Chain | None, row: Column) -> DataFrame:
    """(row, lang_pred, score) of every document; ``row`` is carried along untouched."""
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                names, score, _ = predict(known, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(names), pa.array(score)],
                    names=["row", "lang_pred", "score"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def label(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    row = F.struct("doc_id", (fold() == HELD_OUT).alias("held_out"))
    return identify(docs, learn(docs), row).select("row.*", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
    """Documents whose language is known by enough evidence, with all their columns.

    Only the text goes to Python and only the decision comes back.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            kept = []
            for part in slices(batch, size=AT_ONCE):
                names, _, told = predict(shipped.value, part.column("text"))
                kept += [x != UNKNOWN and e >= least for x, e in zip(names, told, strict=True)]
            yield pa.array(kept, pa.bool_())

    return docs.where(known(F.col("text").cast("string")))
