"""Distinct sampled segmentations of texts over a SentencePiece vocabulary, and decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces. Piece weights follow Zipf's law over the
model's ranks (``(rank + 2) ** -alpha``), which gives every path a probability. Gumbel top-k draws k distinct paths
without replacement: each path's log-probability is perturbed by Gumbel noise and the k largest are kept. The
search is A-star, best first: backward log-sums over the lattice are exact heuristics, so the largest perturbed
value below any open set of paths is one truncated Gumbel draw, and only the sets that hold a result are opened.

A batch of documents is stepped together in numpy, over the lattices of its distinct chunks (words with their
leading ``▁``). Noise is a hash of (seed, doc_id, sample, chunk, step): results
depend on neither batches nor tasks.

Defined results: a null or empty text has the one empty segmentation (rank 1, no pieces, probability 1); a text
with fewer than k segmentations gives as many rows as it has; repeated rows and ids get equal samples; a null id
is seeded as 0; an empty table gives no rows; extra columns are ignored. Unknown characters fall back to byte
pieces. A run without spaces is one lattice, however long. U+2581 in a text decodes as a space.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tidebook.llm.common import batches as arrow

SPACE = "▁"
#: Chunks up to so many characters are summed and walked together; longer ones by themselves, position by position.
TOGETHER = 4096
#: So few chunks that still go on after TOGETHER // 32 decisions are walked by themselves.
FEW = 16
#: Characters of the documents that are stepped together.
PORTION = 3_000_000
#: Open sets are drawn as far as a path's log-probability falls by so much, and further where that does not settle the largest.
REACH = 32.0
#: No hashed Gumbel lies above its location by more: -log(-log(1 - 2 ** -33)) is 22.88.
HIGHEST = 23.0
K, ALPHA, SEED = 3, 0.5, 42


def chunked(texts: list):
    """The lattice's independent parts: characters and sizes of the distinct chunks, each place's chunk, places by text.

    A chunk is a run of spaces with the word after it, as every text opens with one space more; an empty text has none.
    """
    import numpy as np
    import pyarrow as pa

    bodies = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([0, *map(len, bodies)])
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    space = raw == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(opens)
    offsets = np.append(at, len(raw)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    if not len(at):
        return np.zeros(0, np.int32), at, at, np.zeros(len(texts), np.int64)
    _, bounds, data = coded.dictionary.buffers()
    bounds = np.frombuffer(bounds, np.int64)[: len(coded.dictionary) + 1]
    body = data.to_pybytes()[: bounds[-1]]
    lead = np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    sizes = np.diff(lead[bounds[1:] - 1], prepend=0)
    chars = np.frombuffer(body.decode("utf-8", "surrogatepass").replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.int32)
    return chars, sizes, coded.indices.to_numpy(), np.diff(np.searchsorted(at, ends))


class Lattice:
    """The vocabulary as a trie, and the lattices of a batch of chunks as arrays.

    A state is what is left of a chunk, shared by all chunks that end in it; its options are the pieces that it starts with.
    """

    DENSE = 256

    def __init__(self, model: str | None = None, alpha: float = ALPHA):
        import numpy as np
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.names) if sp.is_byte(i)}
        self.wide: dict[int, object] = {}
        self.raw = None
        self.ascii = np.array([self.byte[b] for b in range(128)])
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and sp.get_score(i) > -1e8]
        self.pieces = {self.names[i]: (i, -alpha * math.log(r + 2)) for r, i in enumerate(sorted(plain, key=lambda i: -sp.get_score(i)))}
        self.longest = max(map(len, self.pieces))
        node: dict[str, int] = {"": 0}
        for p in self.pieces:
            for n in range(1, len(p) + 1):
                node.setdefault(p[:n], len(node))
        often: dict[str, int] = {}
        for p in node:
            if p:
                often[p[-1]] = often.get(p[-1], 0) + 1
        dense = {c: i for i, c in enumerate(sorted(often, key=lambda c: (-often[c], c))[: self.DENSE])}
        self.column = np.full(0x110000, -1, dtype=np.int16)
        self.table = np.full((len(node), self.DENSE), -1, dtype=np.int32)
        self.piece, self.score = np.full(len(node), -1, dtype=np.int32), np.zeros(len(node))
        rare = []
        for c, i in dense.items():
            self.column[ord(c)] = i
        for p, at in node.items():
            if p in self.pieces:
                self.piece[at], self.score[at] = self.pieces[p]
            if p and p[-1] in dense:
                self.table[node[p[:-1]], dense[p[-1]]] = at
            elif p:
                rare.append((node[p[:-1]] * 0x110000 + ord(p[-1]), at))
        rare.sort()
        self.rare_key, self.rare_node = (np.array([r[k] for r in rare] or [0], dtype=np.int64) for k in (0, 1))

    def _child(self, node, char):
        import numpy as np

        column = self.column[char]
        out = self.table[node, np.maximum(column, 0)]
        odd = np.flatnonzero(column < 0)
        if len(odd):
            key = node[odd].astype(np.int64) * 0x110000 + char[odd]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            out[odd] = np.where(self.rare_key[at] == key, self.rare_node[at], -1)
        return out

    def build(self, chars, sizes) -> None:
        """Lattices of chunks of so many of ``chars`` each: sets ``begin`` (a chunk's first state) and the option arrays."""
        import numpy as np

        self.to = self.code = self.first = self.logp = self.cum = None  # the last batch's go before new ones come
        ends = np.cumsum(sizes)
        # one state for each distinct rest of a chunk, by characters to the end; those of long chunks last, each by itself
        state_of, rep, levels = np.empty(len(chars), np.int32), np.empty(len(chars), np.int32), [0]
        alive = np.flatnonzero(sizes <= TOGETHER)
        rest = np.zeros(len(alive), np.int64)
        while len(alive):
            at = ends[alive] - len(levels)
            distinct, rest = np.unique(rest * 0x110000 + chars[at], return_inverse=True)
            rest += levels[-1]
            state_of[at], rep[rest] = rest, at
            levels.append(levels[-1] + len(distinct))
            longer = sizes[alive] >= len(levels)
            alive, rest = alive[longer], rest[longer]
        long = np.flatnonzero(sizes > TOGETHER)
        n = levels[-1]
        if len(long):
            far = np.flatnonzero(np.repeat(sizes > TOGETHER, sizes))
            state_of[far] = np.arange(n, n + len(far))
            rep[n : n + len(far)] = far
            n += len(far)
        rep = rep[:n].copy()
        end = np.repeat(ends.astype(np.int32), sizes)[rep]
        self.begin = state_of[ends - sizes]
        at, node = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        parts, depth = [], 0
        count = np.zeros(n, dtype=np.int16)  # options found so far, by state
        while len(at):
            node = self._child(node, chars[rep[at] + depth])
            depth += 1
            hit = np.flatnonzero((node >= 0) & (self.piece[node] >= 0))
            if depth == 1:  # characters without a piece of their own are spelled in bytes
                bare = np.flatnonzero((node < 0) | (self.piece[node] < 0))
                c = chars[rep[at[bare]]]
                spelled = np.where(c < 128, self.ascii[np.minimum(c, 127)], -1 - c)
                parts.append((at[bare], count[at[bare]], 1, spelled, -12.0 * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
                count[at[bare]] += 1
            parts.append((at[hit], count[at[hit]], depth, self.piece[node[hit]], self.score[node[hit]]))
            count[at[hit]] += 1
            live = np.flatnonzero((node >= 0) & (rep[at] + depth < end[at]))
            at, node = at[live], node[live]
        # a state's options lie together, longest, so likeliest, first: the same in any batch
        counts = count.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        total = int(self.first[-1])
        self.to, self.code, score = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        after = self.first[1:] - 1
        state_of = np.append(state_of, np.int32(-1))
        while parts:
            own, before, length, piece, gain = parts.pop()
            place = after[own] - before
            target = rep[own] + length
            self.to[place] = np.where(target == end[own], np.int32(-1), state_of[target])
            self.code[place], score[place] = piece, gain
        del after, state_of, rep, end
        beta, value = np.zeros(n + 1), np.empty(total)  # the last sum, of no state, is that of an end
        for c in long.tolist():
            self._sum_alone(int(self.begin[c]), int(self.begin[c] + sizes[c]), score, value)
        for x, y in zip(levels, levels[1:], strict=False):
            a, b = int(self.first[x]), int(self.first[y])
            v, cut, own = score[a:b] + beta[self.to[a:b]], self.first[x:y] - a, counts[x:y]
            top = np.maximum.reduceat(v, cut)
            beta[x:y] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, own)), cut))
            np.subtract(v, np.repeat(beta[x:y], own), out=value[a:b])
        del score
        start = np.repeat(np.arange(n, dtype=np.int32), counts)
        self.logp = np.minimum(value, 0.0, out=value)
        run = np.exp(self.logp)
        np.cumsum(run, out=run)
        base = np.where(self.first[:-1] > 0, run[self.first[:-1] - 1], 0.0)
        run -= base[start]
        np.minimum(run, 1.0, out=run)
        run += start
        self.cum = run
        self.cum[self.first[1:] - 1] = np.arange(1, n + 1)  # the last option takes the rest

    def _sum_alone(self, begin: int, end: int, score, value) -> None:
        """Backward log-sums of the one chunk of the states from begin to end, in blocks of positions."""
        exp, log, high, sums = math.exp, math.log, end, {-1: 0.0}
        while high > begin:
            low = max(begin, high - TOGETHER)
            a, b = int(self.first[low]), int(self.first[high])
            first, to, gain = (self.first[low : high + 1] - a).tolist(), self.to[a:b].tolist(), score[a:b].tolist()
            for s in range(high - 1, low - 1, -1):
                i, j = first[s - low], first[s - low + 1]
                own = [gain[o] + sums[to[o]] for o in range(i, j)]
                top = max(own)
                sums[s] = total = top + log(sum([exp(v - top) for v in own]))
                gain[i:j] = [v - total for v in own]
            value[a:b] = gain
            sums, high = {-1: 0.0} | {s: sums[s] for s in range(low, min(low + self.longest + 1, end))}, low

    def spell(self, codes):
        """Piece ids of an array of option codes; a negative code is a character to be spelled in several bytes."""
        import numpy as np

        if codes.min(initial=0) >= 0:
            return codes
        at = np.flatnonzero(codes < 0)
        parts, last = [], 0
        for place, c in zip(at.tolist(), (-1 - codes[at]).tolist(), strict=True):
            if c not in self.wide:
                self.wide[c] = np.array([self.byte[b] for b in chr(c).encode("utf-8", "replace")])
            parts += [codes[last:place], self.wide[c]]
            last = place + 1
        return np.concatenate([*parts, codes[last:]])

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids."""
        out, raw = [], bytearray()
        bytes_of = {i: b for b, i in self.byte.items()}
        for i in ids:
            if i in bytes_of:
                raw.append(bytes_of[i])
            else:
                out += [raw.decode("utf-8", "replace"), self.names[i]]
                raw = bytearray()
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")

    def decode_lists(self, lists):
        """``decode`` of every row of an Arrow list array of ids at once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.raw is None:
            of = {i: bytes([b]) for b, i in self.byte.items()}
            self.raw = pa.array([of.get(i, n.replace(SPACE, " ").encode()) for i, n in enumerate(self.names)], pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.raw.take(lists.values)), b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8: row by row
            return pa.array([None if ids is None else self.decode(ids) for ids in lists.to_pylist()], pa.string())
        text = pc.replace_substring(text, SPACE, " ")  # as spelled in bytes
        text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        return pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))


MIX, STRIDE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _place(sample, chunk, step):
    """What a decision's hash starts from, before its step's further strides and its document's seed."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = chunk.astype(np.uint64)
        x *= np.uint64(MIX)
        x += np.uint64((sample + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
        if step is not None:
            x += step.astype(np.uint64) * np.uint64(STRIDE)
    return x


def _spread(x, both: bool = True):
    """Two hashed uniforms in (0, 1), or the first alone, for each element of x, which is used up."""
    import numpy as np

    with np.errstate(over="ignore"):
        for shift, mult in ((30, STRIDE), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(mult)
        x ^= x >> np.uint64(31)
    halves = [(x >> np.uint64(32)).astype(np.float64)]
    if both:
        x &= np.uint64(0xFFFFFFFF)
        halves.append(x.astype(np.float64))
    for half in halves:
        half += 0.5
        half /= 4294967296.0
    return halves if both else halves[0]


def _ranges(low, n):
    """The places from each low on, n of them, one range after another."""
    import numpy as np

    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _uniforms(seed, sample, chunk, step):
    return _spread(_place(sample, chunk, step) ^ seed)


def _truncated(phi, bound, u):
    """A Gumbel of location phi, given that it lies below bound; no Gumbel, so -inf, where phi is -inf."""
    import numpy as np

    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        drawn = phi - bound
        np.exp(drawn, out=drawn)
        drawn -= np.log(u)
        np.log(drawn, out=drawn)
        np.subtract(phi, drawn, out=drawn)
    return np.minimum(drawn, bound, out=drawn)


class _Walk:
    """Decisions of one sample for many documents, in document and text order.

    Only the largest open set of a document counts. Along a path the log-probability falls, and no draw lies more than
    HIGHEST above it, so a document's first decisions hold the largest, all but always; the others' are not drawn.
    """

    def __init__(self, lattice, doc, chunk, state, seeds, sample, bound, before, first_step=None):
        import numpy as np

        cum, to, first = lattice.cum, lattice.to, lattice.first
        self.lattice, self.chunk, self.first_step = lattice, chunk, first_step
        self.seeds, self.sample, self.bound, self.before = seeds, sample, bound, before
        occ, count = np.arange(len(state), dtype=np.int32), np.zeros(len(state), np.int64)
        place, seed = _place(sample, chunk, first_step), seeds[doc]
        parts, turn = [], 0
        while len(occ):
            if turn >= TOGETHER // 32 and len(occ) <= FEW:
                for o, s in zip(occ.tolist(), state.tolist(), strict=True):
                    step = turn + (0 if first_step is None else int(first_step[o]))
                    option = self._alone(lattice, int(doc[o]), int(chunk[o]), s, step, seeds, sample)
                    count[o] += len(option)
                    parts.append((o, turn + np.arange(len(option)), option))
                break
            with np.errstate(over="ignore"):
                target = _spread((place + np.uint64(turn * STRIDE & 0xFFFFFFFFFFFFFFFF)) ^ seed, both=False)
            target += state
            option = first[state]
            ahead = np.flatnonzero(cum[option] <= target)
            while len(ahead):  # options are few and the first ones likely
                later = option[ahead] + 1
                option[ahead] = later
                ahead = ahead[cum[later] <= target[ahead]]
            parts.append((occ, turn, option))
            turn += 1
            count[occ] = turn
            state = to[option]
            live = np.flatnonzero(state >= 0)
            occ, state, place, seed = occ[live], state[live], place[live], seed[live]
        # a chunk's decisions lie together: its round within the walk is its place among them
        ends = np.cumsum(count)
        self.begin, total = ends - count, int(count.sum())
        self.option = np.empty(total, np.int32)
        for own, round_, option in parts:
            self.option[self.begin[own] + round_] = option
        del parts
        self.start = np.append(self.begin, total)[np.searchsorted(doc, np.arange(len(seeds) + 1))]
        self.run = run = np.zeros(total + 1)
        np.cumsum(lattice.logp[self.option], out=run[1:])
        low, high = self.start[:-1], self.start[1:]
        self.total = run[high] - run[low] + before
        self.code = lattice.code[self.option]
        self.taken: dict[int, list[int]] = {}
        # the decisions within REACH lead each document's, as run never rises; the ceiling is that of all others
        near = np.minimum(len(run) - np.searchsorted(run[::-1], run[low] - REACH), high) - low
        self.cut = np.concatenate([[0], np.cumsum(near)])
        self.ceiling = np.where(low + near < high, run[low + near] - run[low] + before + HIGHEST, -np.inf)
        self.whole: dict[int, object] = {}
        self.open = self._drawn(np.arange(len(seeds)), near)
        # per document, the largest open value and its place
        self.value, self.place = np.full(len(seeds), -np.inf), np.full(len(seeds), -1)
        full = np.flatnonzero(near)
        if len(full):
            self.value[full] = np.maximum.reduceat(self.open, self.cut[full])
            hit = np.flatnonzero(self.open == np.repeat(self.value, near))[::-1]
            owner = np.searchsorted(self.cut, hit, "right") - 1
            self.place[owner] = hit - self.cut[owner] + low[owner]
        for d in np.flatnonzero(self.value < self.ceiling).tolist():
            self._settle(d)

    def _drawn(self, docs, n):
        """Open values of the first n decisions of each of the documents, one document after another."""
        import numpy as np

        at, doc = _ranges(self.start[docs], n), np.repeat(docs, n)
        own = self.begin.searchsorted(at, "right") - 1
        step = at - self.begin[own] + (0 if self.first_step is None else self.first_step[own])
        noise = _spread(_place(self.sample, self.chunk[own], step) ^ self.seeds[doc])[1]
        lp = self.lattice.logp[self.option[at]]
        sure = lp > -1e-15
        with np.errstate(divide="ignore"):
            rest = np.log(np.negative(np.expm1(lp, out=lp), out=lp), out=lp)
        rest[sure] = -np.inf
        rest += self.run[at] - self.run[self.start[doc]] + self.before[doc]
        return _truncated(rest, self.bound[doc], noise)

    def prefix(self, doc: int, at: int) -> float:
        """The log-probability of a document's path before the decision at a place."""
        return self.run[at] - self.run[self.start[doc]] + self.before[doc]

    def decision(self, at: int) -> tuple[int, int, int]:
        """The state, chunk and step of the decision at a place."""
        own = int(self.begin.searchsorted(at, "right")) - 1
        step = at - int(self.begin[own]) + (0 if self.first_step is None else int(self.first_step[own]))
        return int(self.lattice.first.searchsorted(self.option[at], "right")) - 1, int(self.chunk[own]), step

    def _own(self, doc: int):
        """A document's open values, of all its decisions or of the first ones."""
        return self.whole[doc] if doc in self.whole else self.open[self.cut[doc] : self.cut[doc + 1]]

    def _settle(self, doc: int) -> None:
        """A document's largest open value: drawn further where one that is not drawn yet may be larger."""
        import numpy as np

        own = self._own(doc)
        if own.max() < self.ceiling[doc]:
            self.whole[doc] = self._drawn(np.array([doc]), self.start[doc + 1 : doc + 2] - self.start[doc])
            self.whole[doc][: len(own)] = own
            own, self.ceiling[doc] = self.whole[doc], -np.inf
        best = int(own.argmax())
        self.place[doc], self.value[doc] = int(self.start[doc]) + best, own[best]

    def redraw(self, doc: int, at: int, drawn: float) -> None:
        """A new value for the decision at a place of a document."""
        self._own(doc)[at - int(self.start[doc])] = drawn
        self._settle(doc)

    @staticmethod
    def _alone(lattice, doc, chunk, state, step, seeds, sample):
        """The same decisions for the rest of one chunk, one after another."""
        import numpy as np

        cum, to, first = lattice.cum, lattice.to, lattice.first
        options = []
        while state >= 0:
            u, _ = _uniforms(seeds[doc], sample, np.full(TOGETHER, chunk), np.arange(step, step + TOGETHER))
            for x in u.tolist():
                option = int(first[state])
                while cum[option] <= state + x:
                    option += 1
                options.append(option)
                state = int(to[option])
                if state < 0:
                    break
            step += TOGETHER
        return np.array(options)


def sample_batch(lattice: Lattice, ids: list, texts: list, k: int = K, seed: int = SEED) -> list[tuple]:
    """(row, rank, piece ids, log probability, perturbed value, inclusion probability) of each sample."""
    import numpy as np

    n = len(texts)
    chars, lengths, known, sizes = chunked(texts)
    if not len(chars):  # a batch of empty texts needs no lattice
        chars, lengths = np.array([ord(SPACE)], np.int32), np.array([1])
    lattice.build(chars, lengths)
    to, piece, logp, first = lattice.to, lattice.code, lattice.logp, lattice.first
    all_states = lattice.begin[known]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    chunk = (np.arange(len(doc)) - begin[doc]).astype(np.int32)
    with np.errstate(over="ignore"):
        keys = np.array([(0 if i is None else i) & 0xFFFFFFFFFFFFFFFF for i in ids], dtype=np.uint64)
        seeds = (keys + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    nil = np.full(n, -1)  # a place apart from all chunks
    value = -np.log(-np.log(_uniforms(seeds, 0, nil, nil)[0]))
    walks = [_Walk(lattice, doc, chunk, all_states, seeds, 0, value, np.zeros(n))]
    # heads[j][d]: codes before walk j's own decisions of document d; None where the document has no such sample
    nothing = np.zeros(0, np.int32)
    heads: list[list] = [[nothing] * n]
    values, alive = [value], np.ones(n, bool)
    found = [(alive.copy(), walks[0].total)]
    kappa = None
    for j in range(1, k + 1):
        stacked = np.stack([w.value for w in walks])
        source, value = stacked.argmax(0), stacked.max(0)
        alive = alive & ~np.isneginf(value)
        if j == k:
            kappa = np.where(alive, value, -np.inf)
            break
        before, head = np.zeros(n), [None] * n
        u, again = _uniforms(seeds, j, nil, nil)
        split, rests, turns = [], [], []
        for d in np.flatnonzero(alive).tolist():
            w = walks[source[d]]
            at = int(w.place[d])
            state, place, step = w.decision(at)
            a, c = int(first[state]), int(first[state + 1] - first[state])
            gone = w.taken.setdefault(at, [int(w.option[at])])
            left = [o for o in range(a, a + c) if o not in gone]
            mass = [math.exp(logp[o]) for o in left]
            x, pick = u[d] * sum(mass), left[-1]
            for o, m in zip(left, mass, strict=True):
                if x < m:
                    pick = o
                    break
                x -= m
            gone.append(pick)
            rest = sum(m for o, m in zip(left, mass, strict=True) if o != pick)
            split.append((w, at, d))
            prefix = w.prefix(d, at)
            rests.append(prefix + math.log(rest) if rest > 0 and len(left) > 1 else -math.inf)
            lo = int(w.start[d])
            head[d] = np.concatenate([heads[source[d]][d], w.code[lo:at], piece[pick : pick + 1]])
            before[d] = prefix + logp[pick]
            turns.append((place, int(to[pick]), step + 1))
        if split:
            docs = np.array([d for *_, d in split])
            for (w, at, d), drawn in zip(split, _truncated(np.array(rests), value[docs], again[docs]).tolist(), strict=True):
                w.redraw(d, at, drawn)
        # each document's rest: the chunk of the decision, if it goes on, and all later ones
        owners = np.array([d for *_, d in split], np.int64)
        places, entries, steps = np.array(turns, np.int64).reshape(-1, 3).T
        goes = entries >= 0
        low = begin[owners] + places + ~goes
        count = begin[owners + 1] - low
        rest = _ranges(low, count)
        states, stepped = all_states[rest], np.zeros(len(rest), np.int32)
        entered = (np.cumsum(count) - count)[goes]
        states[entered], stepped[entered] = entries[goes], steps[goes]
        walks.append(_Walk(lattice, doc[rest], chunk[rest], states, seeds, j, value, before, stepped))
        heads.append(head)
        values.append(value)
        found.append((alive.copy(), walks[-1].total))
    out = []
    for j, (has, total) in enumerate(found):
        w = walks[j]
        with np.errstate(over="ignore"):
            inclusion = np.where(np.isneginf(kappa), 1.0, -np.expm1(-np.exp(np.minimum(total - np.where(np.isneginf(kappa), 0, kappa), 50))))
        for d in np.flatnonzero(has).tolist():
            codes = np.concatenate([heads[j][d], w.code[w.start[d] : w.start[d + 1]]])
            out.append((d, j + 1, lattice.spell(codes), float(total[d]), float(values[j][d]), float(inclusion[d])))
        walks[j] = heads[j] = None
    return out


def samples(docs: DataFrame, k: int = K, alpha: float = ALPHA, seed: int = SEED, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, sample (1..k), n_pieces, ids_crc32, log_prob, perturbed, inclusion and, if asked for, ids and the text decoded from them."""
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double" + (", ids array<int>, decoded string" if with_ids else "")

    def drawn(batches):
        import numpy as np
        import pyarrow as pa

        lattice = Lattice(model, alpha)
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                texts, chars = [], 0
                while at + len(texts) < len(ids) and (not texts or chars < PORTION):
                    texts.append(column[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                rows, found = [], []
                for d, rank, pieces, log_prob, perturbed, inclusion in sample_batch(lattice, ids[at : at + len(texts)], texts, k, seed):
                    found.append(pieces.astype("<i4", copy=False))
                    crc = zlib.crc32(found[-1].tobytes())
                    rows.append((ids[at + d], rank, len(pieces), crc, round(log_prob, 6), round(perturbed, 6), round(inclusion, 6)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32())))
                    cols.append(lattice.decode_lists(cols[-1]))
                at += len(texts)
                whole = pa.RecordBatch.from_arrays(cols, names=names)
                del rows, found, cols, texts
                yield whole
                del whole

    return arrow(docs.select("doc_id", "text")).mapInArrow(drawn, schema)


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows (with ``ids array<int>``) and the text of each row's ids as ``decoded``; null ids have a null text."""

    def spelled(batches):
        import pyarrow as pa

        lattice = Lattice(model)
        for batch in batches:
            lists = batch.column("ids")
            whole = lattice.decode_lists(pa.array(lists.to_pylist(), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], names=[*batch.schema.names, "decoded"])

    fields = rows.drop("decoded")
    return arrow(fields).mapInArrow(spelled, StructType([*fields.schema.fields, StructField("decoded", StringType())]))


def query(docs: DataFrame) -> DataFrame:
    return samples(docs)
