"""SentencePiece encoding with several distinct sampled segmentations per text, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import given_id, row_id

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 1.5  # a piece of merge rank r weighs (1 + r) ** -SHARPNESS, about as often as such words occur
SEED = 17
SPACE_MARK = "▁"
GROUP = 1 << 20  # bytes of text whose equal words share one lattice
SLICE = 1 << 16  # bytes of text that are walked together
TABLE_BITS = 18
FILTER_BITS = 20
NOISE = A.U(0xBF58476D1CE4E5B9)

ENCODED = "id long, sample int, ids array<int>, log_prob double, log_inclusion double"


class Pieces(NamedTuple):
    """The vocabulary as arrays: sorted hashes of the pieces' bytes (the space mark as a space), and of all
    beginnings of pieces. `table` has the first piece by the leading bits of its hash, `begun` is a bitmap."""

    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    table: np.ndarray
    probes: int  # most pieces that share these bits
    begun: np.ndarray
    longest: int
    byte_ids: np.ndarray
    fallback: float
    texts: list  # bytes of each id, for decoding


def load(model_file: str = MODEL, sharpness: float = SHARPNESS) -> Pieces:
    """Read a public SentencePiece model with byte fallback on the driver; the arrays go to the executors.
    A merge model has ranks instead of probabilities, so the weight of a piece follows from its rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    byte_ids, texts, ids = np.zeros(256, np.int64), [], []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE_MARK, " ").encode())
            ids.append(i)
    best = max(model.get_score(i) for i in ids)
    weight = {i: -sharpness * np.log1p(best - model.get_score(i)) for i in ids}
    if any(b" " in texts[i].lstrip(b" ") for i in ids):
        raise ValueError("a piece goes on after a space: words are no units of this model")
    size = np.array([len(texts[i]) for i in ids])
    begin = np.cumsum(size) - size
    prefix = A.WORDS.prefix(np.frombuffer(b"".join(texts[i] for i in ids), np.uint8))
    hashes = _key(prefix, begin, begin + size)
    order = np.argsort(hashes)
    start = np.repeat(begin, size)  # every beginning of every piece
    begun = np.unique(_key(prefix, start, np.arange(len(start)) + 1))
    bits = hashes[order] >> A.U(64 - TABLE_BITS)
    table = np.searchsorted(bits, np.arange(1 << TABLE_BITS, dtype=np.uint64)).astype(np.int32)
    probes = int(np.unique(bits, return_counts=True)[1].max())
    return Pieces(
        hashes[order], np.array(ids)[order], np.array([weight[i] for i in ids])[order], table, probes, _bitmap(begun),
        max(len(texts[i]) for i in ids), byte_ids, min(weight.values()) - 1.0, texts,
    )


def _key(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of a slice whose leading bits are good enough for tables; cheaper than a finished one."""
    return (prefix[end] - prefix[start]) * A.WORDS.inverses[start] * A.U(0x9E3779B97F4A7C15)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(hashes >> A.U(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


class Lattice(NamedTuple):
    """Edges sorted by wave and end. A wave holds the nodes equally far from the start of their chunk; no
    edge crosses the border of a chunk, so chunks are independent of one another."""

    src: np.ndarray
    size: np.ndarray
    piece: np.ndarray  # place in Pieces, -1 for byte fallback
    weight: np.ndarray
    first: np.ndarray  # of each node: its first edge
    count: np.ndarray
    ahead: np.ndarray  # log weight of all paths from the chunk's start to a node within it
    total: np.ndarray  # the same at the chunk's end
    border: np.ndarray  # nodes where chunks begin or end
    log_p: np.ndarray  # of an edge, given the node where it ends
    wait: np.ndarray  # of an edge: one over its probability, e^700 at most; times -log(noise) it is an exponential time
    mark: np.ndarray  # of an edge, for its noise


def lattice(pieces: Pieces, buf: np.ndarray, offs: np.ndarray) -> Lattice:
    """All pieces that match the bytes anywhere, found one byte longer at a time as in a trie."""
    n = len(buf)
    prefix = A.WORDS.prefix(buf)
    limit = np.repeat(offs[1:], np.diff(offs))
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    whole_char = np.zeros(n, bool)
    char_size = np.diff(np.append(at, n))
    # characters of a text end with it
    char_size = np.minimum(char_size, limit[at] - at)
    size_of = np.zeros(n, np.int64)
    size_of[at] = char_size
    chars = at
    found = []
    for size in range(1, pieces.longest + 1):
        at = at[at + size <= limit[at]]
        if not len(at):
            break
        h = _key(prefix, at, at + size)
        on = np.flatnonzero(pieces.begun[(h >> A.U(64 - FILTER_BITS)).astype(np.int64)])
        at, h = at[on], h[on]
        first = pieces.table[(h >> A.U(64 - TABLE_BITS)).astype(np.int64)]
        for probe in range(pieces.probes):
            place = np.minimum(first + probe, len(pieces.hashes) - 1)
            ok = np.flatnonzero(pieces.hashes[place] == h)
            own = at[ok]
            if size <= 4:
                whole_char[own[size_of[own] == size]] = True
            found.append((own.astype(np.int32), np.full(len(own), size, np.int32), place[ok].astype(np.int32)))
    lone = chars[~whole_char[chars]]
    found.append((lone.astype(np.int32), size_of[lone].astype(np.int32), np.full(len(lone), -1, np.int32)))
    src, size, piece = (np.concatenate(x) for x in zip(*found))
    del found, prefix, limit, at, chars, lone, whole_char, size_of, char_size
    weight = np.where(piece >= 0, pieces.weights[piece], pieces.fallback * size)
    crossed = np.bincount(src + 1, minlength=n + 2)[: n + 1] - np.bincount(src + size, minlength=n + 1)[: n + 1]
    border = np.cumsum(crossed) == 0
    # how far a node is from the last border before it
    wave = np.zeros(n + 1, np.int64)
    wave[1:] = np.arange(1, n + 1) - np.maximum.accumulate(np.where(border, np.arange(n + 1), 0))[:-1]
    end = src + size
    order = np.argsort(end, kind="stable")
    of_wave = wave[end[order]]
    order = order[np.argsort(of_wave.astype(np.uint16) if wave.max() < 65536 else of_wave, kind="stable")]
    src, size, piece, weight, end = src[order], size[order], piece[order], weight[order], end[order]
    del order, of_wave, crossed
    heads = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.empty(0, np.int64)
    nodes = end[heads]
    count = np.zeros(n + 1, np.int64)
    first = np.zeros(n + 1, np.int64)
    first[nodes], count[nodes] = heads, np.diff(np.append(heads, len(end)))
    ahead, total = np.zeros(n + 1), np.zeros(n + 1)
    waves = wave[nodes]
    cuts = np.flatnonzero(np.append(True, waves[1:] != waves[:-1])) if len(nodes) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(nodes)) if len(nodes) else []):
        e0, e1 = heads[a], heads[b] if b < len(heads) else len(end)
        value = ahead[src[e0:e1]] + weight[e0:e1]
        local = heads[a:b] - e0
        most = np.maximum.reduceat(value, local)
        value = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, count[nodes[a:b]])), local))
        total[nodes[a:b]] = value
        inner = ~border[nodes[a:b]]
        ahead[nodes[a:b][inner]] = value[inner]
    log_p = ahead[src] + weight - total[end]
    mark = (src.astype(np.uint64) * A.U(64) + size.astype(np.uint64)) * NOISE
    return Lattice(src, size, piece, weight, first, count, ahead, total, border, log_p, np.exp(np.minimum(-log_p, 700.0)), mark)


class Walk(NamedTuple):
    """Choices of one sample in a group, in order of text, chunk and step (a chunk is walked from its end): the edge
    taken, and all edges that could have been with their times. The perturbed score of an edge before truncation is minus
    the log of its time, so the edge taken is that of least time."""

    text: np.ndarray
    chunk: np.ndarray
    step: np.ndarray
    edge: np.ndarray
    log_p: np.ndarray  # of the edge taken, given what came before
    least: np.ndarray  # time of the edge taken
    head: np.ndarray  # of each choice: its first option below
    count: np.ndarray
    options: np.ndarray
    time: np.ndarray  # infinite for options that were taken
    second: np.ndarray  # by choice: the least time of an option that is left


def walk(
    net: Lattice, key: np.ndarray, text: np.ndarray, chunk: np.ndarray, node: np.ndarray, step: np.ndarray, round_: int,
    shift: np.ndarray,
) -> Walk:
    """Walk each chunk from `node` back to its start, taking at each node the edge of greatest perturbed
    score: an exact sample. The noise depends on the text's key, the place in the text (`shift` by chunk turns
    nodes into places) and the round only."""
    parts, base = [], 0
    seed = A.mix(key + A.U(round_ * 0x9E3779B97F4A7C15 % 2**64))
    own = seed[text] + (shift[chunk] * 64).astype(np.uint64) * NOISE
    while len(node):
        count = net.count[node]
        heads = np.cumsum(count) - count
        edge = np.arange(heads[-1] + count[-1]) + np.repeat(net.first[node] - heads, count)
        # the mark of the edge at its place in the text, with the text's key and the round
        bits = np.repeat(own, count)
        bits += net.mark[edge]
        u = (A.mix(bits) >> A.U(12)).astype(np.float64)
        u += 0.5
        u *= 2.0**-52
        time = np.log(u, out=u)
        time *= -net.wait[edge]
        least = np.minimum.reduceat(time, heads)
        taken = np.flatnonzero(time == np.repeat(least, count))
        if len(taken) > len(node):  # equal scores: the first stands
            of = np.searchsorted(heads, taken, "right")
            taken = taken[np.append(True, of[1:] != of[:-1])]
        time[taken] = np.inf
        at = edge[taken]
        parts.append((text, chunk, step, at, net.log_p[at], least, heads + base, count, np.minimum.reduceat(time, heads), edge, time))
        base += len(edge)
        node = net.src[at]
        go = np.flatnonzero(~net.border[node])
        text, chunk, node, step, own = text[go], chunk[go], node[go], step[go] + 1, own[go]
    if not parts:
        none, nothing = np.empty(0, np.int64), np.empty(0)
        return Walk(none, none, none, none, nothing, nothing, none, none, none, nothing, nothing)
    *choice, options, times = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(choice[1], kind="stable")  # steps come in order already
    text, chunk, step, edge, log_p, least, head, count, second = (x[order] for x in choice)
    return Walk(text, chunk, step, edge, log_p, least, head, count, options, times, second)


def _ahead_of(walked: Walk, texts: int, start: np.ndarray) -> np.ndarray:
    """Log probability of all choices of the text before each choice, from `start` on."""
    sums = np.concatenate(([0.0], np.cumsum(walked.log_p)))
    first = np.searchsorted(walked.text, np.arange(texts))
    return sums[:-1] - sums[first[walked.text]] + start[walked.text]


def _truncated(second: np.ndarray, least: np.ndarray, before: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Perturbed scores of the options of time `second`, at choices of least time `least`, given that the greatest
    of each choice is `top`: of times, minus the log of exp(-top) + (second - least) * exp(-before)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(second - least)
        v += top
        v -= before
        return top - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))


def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with the spaces before them: where each begins, which of the different ones it is, and the bytes
    and offsets of the different ones."""
    space = buf == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[offs[:-1][offs[:-1] < len(buf)]] = True
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(buf)) if len(begin) else begin
    _, first, inverse = np.unique(A.WORDS.of(A.WORDS.prefix(buf), begin, end), return_index=True, return_inverse=True)
    size = (end - begin)[first]
    at = np.concatenate(([0], np.cumsum(size)))
    joined = buf[np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(begin[first], size)]
    same = np.array_equal(size[inverse], end - begin)
    if not same or not np.array_equal(joined[np.arange(len(buf)) - np.repeat(begin - at[:-1][inverse], end - begin)], buf):
        return begin, np.arange(len(begin)), buf, np.append(begin, len(buf))  # two words share a hash
    return begin, inverse, joined, at


class Words(NamedTuple):
    """The words of some texts, and the lattice of the different ones."""

    net: Lattice
    joined: np.ndarray  # bytes of the different words
    at: np.ndarray  # their offsets
    begin: np.ndarray  # where each word begins in the texts
    which: np.ndarray  # the different word that it is
    ends: np.ndarray  # ends of chunks, as nodes
    low: np.ndarray  # first and last chunk of each different word
    high: np.ndarray


def words_of(pieces: Pieces, buf: np.ndarray, offs: np.ndarray) -> Words:
    begin, which, joined, at = _units(buf, offs)
    net = lattice(pieces, joined, at)
    ends = np.flatnonzero(net.border)
    ends = ends[(ends > 0) & (net.count[ends] > 0)]
    return Words(net, joined, at, begin, which, ends, np.searchsorted(ends, at[:-1], "right"), np.searchsorted(ends, at[1:], "right"))


def sample(words: Words, offs: np.ndarray, keys: np.ndarray, samples: int, seed: int):
    """For each of the texts at `offs` up to `samples` distinct segmentations in order of perturbed score.

    A search over sets of segmentations that agree in their first choices: the perturbed score of a set is
    that of its best member, so the next sample is always the best set left. Yields for each sample
    (text, edges by text and place, log probability); and the greatest score left after all of them."""
    texts = len(offs) - 1
    # a word with the spaces before it is a unit that no piece crosses; equal ones share one lattice
    net, some = words.net, slice(*np.searchsorted(words.begin, (offs[0], offs[-1])))
    begin, which = words.begin[some], words.which[some]
    count = words.high[which] - words.low[which]
    unit = np.repeat(np.arange(len(which)), count)
    ends = words.ends[np.arange(len(unit)) + np.repeat(words.low[which] - (np.cumsum(count) - count), count)]
    owner = (np.searchsorted(offs, begin, "right") - 1)[unit]
    shift = (begin - words.at[which])[unit] - offs[owner]
    key = A.mix(keys.astype(np.int64).view(np.uint64) + A.U(seed * 0x94D049BB133111EB % 2**64))
    number = np.arange(len(ends))
    done: list[tuple] = []
    choices: list[tuple] = []
    zero = np.zeros(texts)
    u = (A.mix(key ^ A.U(0x5DEECE66D)) >> A.U(12)).astype(np.float64)
    top = -np.log(-np.log((u + 0.5) / 2.0**52))
    now = walk(net, key, owner, number, ends, np.zeros(len(ends), np.int64), 0, shift)
    before = _ahead_of(now, texts, zero)
    out = []
    alive = np.isin(np.arange(texts), owner)
    log_prob = np.bincount(now.text, now.log_p, texts)
    path = (now.text, now.chunk, now.step, now.edge, now.log_p)
    for round_ in range(1, samples + 1):
        out.append((path, log_prob.copy(), alive.copy()))
        done.append(path)
        # what the new choices leave open: of each choice the best option not taken
        peak = top[now.text]
        choices.append((now, _truncated(now.second, now.least, before, peak), before, peak))
        top, pick = np.full(texts, -np.inf), [np.empty(0, np.int64)] * len(choices)
        for c, (walked, value, *_) in enumerate(choices):
            text = walked.text
            heads = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.empty(0, np.int64)
            most = np.maximum.reduceat(value, heads) if len(heads) else np.empty(0)
            better = most > top[text[heads]]
            top[text[heads[better]]] = most[better]
            best = np.flatnonzero(value == top[text])
            pick[c] = best[np.append(True, text[best][1:] != text[best][:-1])] if len(best) else best
        if round_ == samples:
            break
        # of equal scores in several rounds the latest stands, as in a search that continues
        latest = np.full(texts, -1)
        for c, (walked, *_) in enumerate(choices):
            latest[walked.text[pick[c]]] = c
        chosen = []
        for c, (walked, value, prior, peak) in enumerate(choices):
            p = pick[c][(latest[walked.text[pick[c]]] == c) & np.isfinite(value[pick[c]])]
            # the option of that time is taken now, and the choice's next best stands for it
            n, heads = walked.count[p], np.cumsum(walked.count[p]) - walked.count[p]
            own = np.arange(n.sum()) + np.repeat(walked.head[p] - heads, n)
            taken = np.flatnonzero(walked.time[own] == np.repeat(walked.second[p], n))
            of = np.searchsorted(heads, taken, "right")
            taken = own[taken[np.append(True, of[1:] != of[:-1])]] if len(taken) else taken
            chosen.append((walked.text[p], np.full(len(p), c), walked.chunk[p], walked.step[p], walked.options[taken], prior[p]))
            if len(p):
                walked.time[taken] = np.inf
                walked.second[p] = np.minimum.reduceat(walked.time[own], heads)
                value[p] = _truncated(walked.second[p], walked.least[p], prior[p], peak[p])
        text, of, chunk, step, edge, prior = (np.concatenate(x) for x in zip(*chosen))
        # the new path: the old one up to the choice, the other option, then afresh
        alive = np.zeros(texts, bool)
        alive[text] = True
        cut_chunk, cut_step = np.full(texts, -1), np.full(texts, -1)
        cut_chunk[text], cut_step[text] = chunk, step
        parent = np.full(texts, -1)
        parent[text] = of
        kept = []
        for s, (t, c, st, e, lp) in enumerate(done):
            same = (parent[t] == s) & ((c < cut_chunk[t]) | ((c == cut_chunk[t]) & (st < cut_step[t])))
            kept.append(tuple(x[same] for x in (t, c, st, e, lp)))
        own = net.weight[edge] + net.ahead[net.src[edge]] - net.total[net.src[edge] + net.size[edge]]
        kept.append((text, chunk, step, edge, own))
        rest = net.src[edge]
        inner = ~net.border[rest]
        later = (number > cut_chunk[owner]) & alive[owner]
        start = zero.copy()
        start[text] = prior + own
        now = walk(
            net, key, np.concatenate((text[inner], owner[later])), np.concatenate((chunk[inner], number[later])),
            np.concatenate((rest[inner], ends[later])),
            np.concatenate((step[inner] + 1, np.zeros(later.sum(), np.int64))), round_, shift,
        )
        before = _ahead_of(now, texts, start)
        kept.append((now.text, now.chunk, now.step, now.edge, now.log_p))
        t, c, st, e, lp = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((st, c))
        path = tuple(x[order] for x in (t, c, st, e, lp))
        log_prob = np.bincount(t, lp, texts)
    return shift, out, top


def _slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE bytes, one text at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1, lo + 1), n)
        yield lo, hi
        lo = hi


def _rows(pieces: Pieces, words: Words, offs: np.ndarray, keys: np.ndarray, samples: int, seed: int) -> Iterator[pa.RecordBatch]:
    net, texts = words.net, len(keys)
    blank = np.diff(offs) == 0
    shift, found, left = sample(words, offs, keys, samples, seed)
    for number, ((text, chunk, _, edge, _), log_prob, alive) in enumerate(found):
        order = np.argsort(net.src[edge] + shift[chunk] + offs[text], kind="stable")
        ids, sizes = _ids(pieces, net, words.joined, edge[order])
        per_text = np.bincount(text[order], sizes, texts).astype(np.int64)
        rows = np.flatnonzero(alive | blank if not number else alive)
        at = np.concatenate(([0], np.cumsum(per_text[rows])))
        gap = log_prob[rows] - left[rows]
        with np.errstate(divide="ignore", over="ignore"):
            inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[rows]), pa.array(np.full(len(rows), number, np.int32)),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                pa.array(log_prob[rows]), pa.array(np.minimum(inclusion, 0.0)),
            ],
            names=["id", "sample", "ids", "log_prob", "log_inclusion"],
        )


def _encoder(pieces: Pieces, samples: int, seed: int, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _joined(pieces) if decoded else None
        for batch in batches:
            keys = A.ids(batch.column("id"))
            for lo, hi, raw, offs in A.byte_groups(batch.column("text"), GROUP):
                # a space before every text that is not empty
                more = (np.diff(offs) > 0).astype(np.int64)
                shift = np.cumsum(more)
                buf = np.full(len(raw) + shift[-1], 0x20, np.uint8)
                buf[np.arange(len(raw)) + np.repeat(shift, np.diff(offs))] = raw
                offs = offs + np.concatenate(([0], shift))
                words = words_of(pieces, buf, offs)
                for a, b in _slices(offs):
                    for rows in _rows(pieces, words, offs[a : b + 1], keys[lo + a : lo + b], samples, seed):
                        yield rows.append_column("decoded", _texts(*vocabulary, rows.column("ids"))) if decoded else rows

    return run


def _ids(pieces: Pieces, net: Lattice, buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces taken, byte by byte where there is no piece; and how many each edge gives."""
    piece = net.piece[edge]
    if len(piece) and piece.min() >= 0:
        return pieces.ids[piece], np.ones(len(edge), np.int64)
    size = net.size[edge]
    sizes = np.where(piece >= 0, 1, size)
    of = np.repeat(np.arange(len(edge)), sizes)
    within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.where(piece[of] >= 0, pieces.ids[piece[of]], pieces.byte_ids[buf[net.src[edge][of] + within]]), sizes


def encode(
    documents: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
    seed: int = SEED, decoded: bool = False,
) -> DataFrame:
    """One row per text and sample (from 0): id, sample, ids, log_prob, log_inclusion; `decoded` adds what `decode` gives,
    in the same task, so the ids need not go to another one.

    The samples of a text are distinct segmentations drawn without replacement by Gumbel top-k: all
    segmentations are perturbed, the best sets are followed first, and log_inclusion is the log probability
    that a segmentation is above the best one left out: log(1 - exp(-exp(log_prob - threshold))), 0 if none
    was left. A text with fewer segmentations gives fewer rows. Noise comes from the row key and the place in
    the text, so a row's samples do not depend on the rows beside it.

    Spaces are pieces' space marks, a space is put before each text, characters without a piece fall back to
    bytes; any text decodes to itself. Empty and null texts give one sample without ids. Rows that share an
    id and text give the same samples each; a null id is a key like others and comes back as null.
    """
    docs = documents.select(row_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.mapInArrow(_encoder(pieces, samples, seed, decoded), ENCODED + ", decoded string" * decoded)
    return rows.withColumn("id", given_id("id")).withColumnRenamed("id", id_col)


def _joined(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids one after the other, and their offsets."""
    return np.frombuffer(b"".join(pieces.texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in pieces.texts])))


def _texts(joined: np.ndarray, at: np.ndarray, lists: pa.ListArray) -> pa.Array:
    """The text of each list of ids, without the space put before it."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = at[ids + 1] - at[ids]
    take = np.arange(size.sum()) + np.repeat(at[ids] - (np.cumsum(size) - size), size)
    rows = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    cuts = np.concatenate(([0], np.cumsum(size)))[rows]
    data = joined[take].tobytes()
    return pa.array([data[a + (data[a : a + 1] == b" ") : b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())


def _decoder(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, at = _joined(pieces)
        for whole in batches:
            ends = np.cumsum(whole.column("__ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < whole.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(ends, before + SLICE, "right")), lo + 1)
                batch = whole.slice(lo, hi - lo)
                lo = hi
                texts = _texts(joined, at, batch.column("__ids").fill_null([]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "decoded"])

    return run


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str | Column = "ids") -> DataFrame:
    """All columns and `decoded`: the text of the ids, without the space put before it. Null ids give ''."""
    kept = encoded.drop("decoded")
    schema = kept.withColumn("decoded", F.lit("")).schema
    return kept.withColumn("__ids", F.col(ids_col) if isinstance(ids_col, str) else ids_col).mapInArrow(_decoder(pieces), schema)
