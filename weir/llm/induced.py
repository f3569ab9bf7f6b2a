"""Suffix order and common prefixes of many byte strings by external induced sorting.

Symbols are numbers; every string ends with the symbol 0. A suffix is of type S if it is smaller
than the one after it, else L; an S suffix behind an L one is a seed, and so is every end.

1. The text is cut at the seeds; the pieces, each up to one symbol beyond the run that the next seed
   begins, are sorted and named. No piece is a prefix of another one, so the names order suffixes.
2. The string of names, at most half as long, is sorted by recursion. A name carries its length in bytes
   and its common prefix with the name before it, so all common prefixes are in bytes on every level.
3. From the sorted seeds all L suffixes are induced in ascending order, from those all S suffixes in
   descending order: a suffix hands the one before it, with that one's first symbol, to a queue. Two
   suffixes of one first symbol share it and what their successors share: the least common prefix met
   since the queue was last given that symbol travels with the tuple.

The queue takes tuples in bulk and keeps sorted runs; beyond ``rows`` tuples it writes them to disk.
Blocks of symbols with at most ``rows`` suffixes are settled at once; a symbol with more is streamed
through the queue in rounds. Larger arrays are mapped from files. The files have no name, lie in Spark's
spill folders and go with the task. Common prefixes are counted up to ``CAP`` bytes.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 254


class Scratch:
    """Arrays of a task: in memory up to ``rows`` entries, else in a file."""

    def __init__(self, rows: int) -> None:
        self.rows = rows
        # Where Spark itself lets Python workers spill.
        folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if f and os.path.isdir(f)]
        self.folder = folders[os.getpid() % len(folders)] if folders else None

    def empty(self, n: int, kind: type) -> np.ndarray:
        if n <= 8 * self.rows:
            return np.empty(n, kind)
        with tempfile.TemporaryFile(dir=self.folder) as file:
            file.truncate(n * np.dtype(kind).itemsize)
            return np.memmap(file, kind, "r+", shape=(n,))

    def filled(self, n: int, kind: type, value: int) -> np.ndarray:
        out = self.empty(n, kind)
        out[:] = value
        return out

    def chunks(self, n: int) -> list[slice]:
        return [slice(i, min(n, i + self.rows)) for i in range(0, n, self.rows)]


class Least:
    """Smallest value in any range of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.table = [values]
        while 2 << len(self.table) - 1 <= len(values):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over places a to b, both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << int(k)) + 1])
        return out


class Queue:
    """Tuples (symbol, position, common prefix), taken by symbol, and for a symbol in the order of coming."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.runs, self.held, self.on_disk = scratch, [], 0, 0

    def push(self, symbol: np.ndarray, pos: np.ndarray, low: np.ndarray) -> None:
        """Tuples sorted by symbol."""
        if len(symbol):
            self.runs.append([symbol, pos, low, 0])
            self.held += len(symbol)
            if self.held > self.scratch.rows:
                self._merge(self.on_disk, True)
            elif len(self.runs) - self.on_disk > 64:
                self._merge(self.on_disk, False)

    def _merge(self, first: int, to_disk: bool) -> None:
        parts = [[x[r[3]:] for x in r[:3]] for r in self.runs[first:]]
        columns = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        columns = [x[order] for x in columns]
        self.held = 0 if to_disk else len(order)
        if to_disk and len(order):
            for i, x in enumerate(columns):
                with tempfile.TemporaryFile(dir=self.scratch.folder) as file:
                    x.tofile(file)
                    file.flush()
                    columns[i] = np.memmap(file, x.dtype, "r", shape=x.shape)
            self.on_disk += 1
        self.runs[first:] = [[*columns, 0]] if len(order) else []

    def take(self, below: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples with a symbol under ``below``; only the first ``most`` of them if these are of one symbol."""
        parts = []
        for i, run in enumerate(self.runs):
            to = run[3] + int(np.searchsorted(run[0][run[3]:], below))
            if most is not None:
                to = min(to, run[3] + most)
                most -= to - run[3]
            if to > run[3]:
                parts.append([np.asarray(x[run[3]:to]) for x in run[:3]])
                self.held -= to - run[3] if i >= self.on_disk else 0
                run[3] = to
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
        columns = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(columns[0], kind="stable") if len(parts) > 1 else slice(None)
        return tuple(x[order] for x in columns)


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 16) -> np.ndarray:
    """Common prefix of the suffixes of ``text`` at a and at b, compared symbol by symbol."""
    n = np.zeros(len(a), np.int64)
    open_, step = np.arange(len(a)), np.arange(width)
    while len(open_):
        x, y = (text[np.minimum((z[open_] + n[open_])[:, None] + step, len(text) - 1)] for z in (a, b))
        same = (x == y) & (x != 0)
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        n[open_] += run
        open_ = open_[(run == width) & (n[open_] < CAP)]
    return np.minimum(n, CAP).astype(np.uint8)


class Level:
    """One level of the recursion: symbols below ``k``, their bytes and common prefixes, and places in the bytes."""

    def __init__(self, symbols: np.ndarray, k: int, size: np.ndarray, before: np.ndarray, base: np.ndarray | None, text: np.ndarray, scratch: Scratch) -> None:
        self.t, self.k, self.size, self.before, self.base, self.text, self.scratch = symbols, k, size, before, base, text, scratch

    def place(self, pos: np.ndarray) -> np.ndarray:
        return pos if self.base is None else self.base[pos]

    def types(self) -> np.ndarray:
        """True for S."""
        out = self.scratch.empty(len(self.t), bool)
        right = True
        for part in reversed(self.scratch.chunks(len(self.t))):
            here = np.asarray(self.t[part])
            after = np.append(here[1:], self.t[part.stop] if part.stop < len(self.t) else 0)
            rises, same = here < after, (here == after) & (here != 0)
            known = np.where(same, len(here), np.arange(len(here)))
            at = np.minimum.accumulate(known[::-1])[::-1]  # the end of the run of equal symbols
            out[part] = np.where(at < len(here), rises[np.minimum(at, len(here) - 1)], right) | (here == 0)
            right = bool(out[part.start])
        return out

    def seeds(self, is_s: np.ndarray) -> np.ndarray:
        found, left = [], True
        for part in self.scratch.chunks(len(self.t)):
            here = is_s[part]
            found.append(part.start + np.flatnonzero((here & ~np.append(left, here[:-1])) | (self.t[part] == 0)))
            left = bool(here[-1])
        n = sum(map(len, found))
        out = self.scratch.empty(n, np.int64)
        if n:
            np.concatenate(found, out=out)
        return out

    def names(self, seeds: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """Names of the pieces at the seeds, their number, and one seed's index for each name."""
        n, rows = len(seeds), self.scratch.rows
        length, first = self.scratch.empty(n, np.int64), self.scratch.empty(n, np.int64)
        bits = max(1, int(self.k).bit_length())
        per = max(1, 62 // bits)
        t = self.t

        def key(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), np.int64)
            for j in range(per):
                more = t[np.minimum(at + j, len(t) - 1)].astype(np.int64)
                out = (out << bits) | np.where(left > j, more, 0)
            return out

        for part in self.scratch.chunks(n):
            here = seeds[part]
            last = np.append(seeds[part.start + 1:part.stop + 1], here[-1:])[:len(here)]
            end, symbol = last.copy(), t[last]
            open_ = np.flatnonzero(symbol != 0)
            while len(open_):
                end[open_] += 1
                open_ = open_[t[end[open_]] == symbol[open_]]
            length[part] = np.where(t[here] == 0, 1, end - here + 1)
            first[part] = key(here, length[part])
        edges = [np.iinfo(np.int64).max]
        if n > rows:  # ranges of about ``rows`` pieces by their first symbols
            sample = np.sort(first[::max(1, n // (1 << 16))])
            edges = [*np.unique(sample[::max(1, len(sample) * rows // (2 * n))][1:]).tolist(), *edges]
        out, total, low, samples = self.scratch.empty(n, np.int32), 0, np.iinfo(np.int64).min, []
        for high in edges:
            at = np.concatenate([p.start + np.flatnonzero((first[p] >= low) & (first[p] < high)) for p in self.scratch.chunks(n)] or [np.empty(0, np.int64)])
            low = high
            if not len(at):
                continue
            rank, active, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
            while len(active):
                now = first[at[active]] if not done else key(seeds[at[active]] + done, length[at[active]] - done)
                order = np.lexsort((now, rank[active]))
                active, now = active[order], now[order]
                old = rank[active]
                head = np.r_[True, (old[1:] != old[:-1])]
                new = head | np.r_[True, now[1:] != now[:-1]]
                places = np.arange(len(active))
                start_old, start_new = np.maximum.accumulate(np.where(head, places, 0)), np.maximum.accumulate(np.where(new, places, 0))
                rank[active] = old + start_new - start_old
                count = np.diff(np.r_[np.flatnonzero(new), len(active)])
                done += per
                active = active[(np.repeat(count, count) > 1) & (length[at[active]] > done)]
            values, one, dense = np.unique(rank, return_index=True, return_inverse=True)
            out[at] = total + dense
            samples.append(at[one])
            total += len(values)
        return out, total, np.concatenate(samples) if samples else np.empty(0, np.int64)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and the common prefix (bytes) of each with the one before it."""
        is_s = self.types()
        seeds = self.seeds(is_s)
        ends = np.flatnonzero(self.t == 0)
        if len(seeds) == len(ends) == len(self.t):
            return ends, np.zeros(len(ends), np.uint8)
        names, k, samples = self.names(seeds)
        base = self.scratch.empty(len(seeds), np.int64)
        for part in self.scratch.chunks(len(seeds)):
            base[part] = self.place(seeds[part])
        size, before = self.scratch.empty(k, np.int64), self.scratch.empty(k, np.uint8)
        for part in self.scratch.chunks(k):
            one = samples[part]
            size[part] = np.where(names[one] == 0, 0, base[np.minimum(one + 1, len(base) - 1)] - base[one])
            before[part] = shared(self.text, base[np.r_[samples[max(part.start - 1, 0)], one[:-1]]], base[one])
        before[:1] = 0
        sub, low = Level(names, k, size, before, base, self.text, self.scratch).order()
        for part in self.scratch.chunks(len(sub)):
            sub[part] = seeds[sub[part]]
        pos, low = self._induced(is_s, False, sub, low)
        back = np.concatenate([np.zeros(1, np.uint8), low[:0:-1]]) if len(low) else low
        pos, low = self._induced(is_s, True, pos[::-1], back)
        n = len(ends)
        out, common = self.scratch.empty(n + len(pos), np.int64), self.scratch.empty(n + len(pos), np.uint8)
        out[:n], out[n:] = ends, pos[::-1]
        common[:n + 1] = 0
        common[n + 1:] = low[:0:-1]
        return out, common

    def _induced(self, is_s: np.ndarray, want: bool, seeds: np.ndarray, seed_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """L suffixes from the sorted seeds (``want`` False); or S and L suffixes, descending, from L ones given descending."""
        t, k, scratch, rows = self.t, self.k, self.scratch, self.scratch.rows
        flip = (lambda x: k - 1 - x) if want else (lambda x: x)
        size = self.size[::-1] if want else self.size
        before = np.concatenate([np.zeros(1, np.uint8), self.before[:0:-1]]) if want else self.before

        def symbol(pos: np.ndarray) -> np.ndarray:
            return flip(t[pos].astype(np.int64))

        targets, total = scratch.filled(k, np.int64, 0), 0
        for part in scratch.chunks(len(t)):
            mask = (is_s[part] == want) & (t[part] != 0)
            values, count = np.unique(flip(t[part][mask].astype(np.int64)), return_counts=True)
            targets[values] += count
            total += int(count.sum())
        seeded = scratch.filled(k + 1, np.int64, 0)
        for part in scratch.chunks(len(seeds)):
            values, count = np.unique(symbol(seeds[part]), return_counts=True)
            seeded[values + 1] += count
        np.cumsum(seeded, out=seeded)
        upto = scratch.filled(k + 1, np.int64, 0)
        np.cumsum(targets, out=upto[1:])
        upto += seeded
        n_out = total + (len(seeds) if want else 0)
        out, out_low = scratch.empty(n_out, np.int64), scratch.empty(n_out, np.uint8)
        queue, carry = Queue(scratch), scratch.filled(k, np.uint8, CAP)
        state = {"at": 0, "low": CAP, "symbol": None}

        def emit(pos: np.ndarray, low: np.ndarray, target: np.ndarray, least: int) -> None:
            """The next part of the sequence: store it, and push what stands before its members and has a symbol of ``least`` or more."""
            if want:
                out[state["at"]:state["at"] + len(pos)], out_low[state["at"]:state["at"] + len(pos)] = pos, low
                state["at"] += len(pos)
            else:
                at = np.flatnonzero(target)
                if len(at):
                    found = np.minimum.reduceat(low, np.r_[0, at[:-1] + 1])
                    # reduceat runs to the next start, or to the end: cut the last one at its member.
                    found[-1] = low[(at[-2] + 1 if len(at) > 1 else 0):at[-1] + 1].min()
                    found[0] = min(int(found[0]), state["low"])
                    out[state["at"]:state["at"] + len(at)], out_low[state["at"]:state["at"] + len(at)] = pos[at], found
                    state["at"] += len(at)
                    state["low"] = int(low[at[-1] + 1:].min(initial=CAP))
                else:
                    state["low"] = min(state["low"], int(low.min(initial=CAP)))
            p = np.maximum(pos - 1, 0)
            s = symbol(p)
            at = np.flatnonzero((pos > 0) & (t[p] != 0) & (is_s[p] == want) & (s >= least))
            s = s[at]
            order = np.argsort(s, kind="stable")
            at, s = at[order], s[order]
            head = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
            falling = np.minimum.accumulate(low)
            least_in = Least(low)
            since = np.minimum(carry[s], falling[at])
            rest = np.flatnonzero(~head)
            since[rest] = least_in(at[rest - 1] + 1, at[rest])
            queue.push(s, pos[at] - 1, since)
            np.minimum(carry, falling[-1], out=carry)
            ends = np.flatnonzero(np.r_[head[1:], True]) if len(s) else np.empty(0, int)
            after = np.append(np.minimum.accumulate(low[::-1])[::-1], np.uint8(CAP))
            carry[s[ends]] = after[at[ends] + 1]

        def boundary(first: int) -> int:
            """Common prefix of the first suffix of a symbol and the last one before."""
            last, state["symbol"] = state["symbol"], first
            return 0 if last is None else int(before[last + 1:first + 1].min())

        def plus(symbols: np.ndarray, low: np.ndarray) -> np.ndarray:
            return np.minimum(size[symbols] + low, CAP).astype(np.uint8)

        lo = 0
        while lo < k:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + rows, side="right")) - 1)
            if upto[hi] - upto[lo] <= rows:
                if upto[hi] > upto[lo]:
                    emit(*self._block(lo, hi, queue, seeds[seeded[lo]:seeded[hi]], seed_low[seeded[lo]:seeded[hi]], is_s, want, symbol, carry, before, plus, state), hi)
            else:
                last = None
                while len((found := queue.take(hi, rows))[0]):
                    low = plus(found[0], found[2])
                    low[0] = boundary(lo) if last is None else low[0]
                    last = found[1][-1:]
                    emit(found[1], low, np.ones(len(low), bool), lo)
                for part in scratch.chunks(int(seeded[hi] - seeded[lo])):
                    pos = np.asarray(seeds[seeded[lo] + part.start:seeded[lo] + part.stop])
                    low = np.array(seed_low[seeded[lo] + part.start:seeded[lo] + part.stop])
                    if not part.start:
                        low[0] = boundary(lo) if last is None else shared(self.text, self.place(last), self.place(pos[:1]))[0]
                    emit(pos, low, np.zeros(len(low), bool), lo)
            lo = hi
        return out, out_low

    def _block(self, lo, hi, queue, seeds, seed_low, is_s, want, symbol, carry, before, plus, state):  # noqa: PLR0913
        """The suffixes of the symbols lo to hi - 1 in order: position, common prefix, whether induced."""
        t = self.t
        s_a, p_a, l_a = queue.take(hi)
        a, b = len(p_a), len(seeds)
        pos, succ = [p_a, np.asarray(seeds)], []
        now, index, n = np.concatenate(pos), np.arange(a + b), a + b
        while len(now):  # what is induced inside the block, step by step
            p = np.maximum(now - 1, 0)
            ok = np.flatnonzero((now > 0) & (t[p] != 0) & (is_s[p] == want) & (symbol(p) < hi))
            now, index = p[ok], index[ok]
            pos.append(now)
            succ.append(index)
            index = np.arange(n, n + len(now))
            n += len(now)
        pos, succ = np.concatenate(pos), np.concatenate(succ)
        s = symbol(pos)
        kind = np.repeat([0, 2, 1], [a, b, n - a - b])
        order = np.lexsort((np.arange(n), kind, s))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        new = np.arange(a + b, n)
        if len(new):
            # Equal symbols tie; ranks of what follows, at doubled distance each time, break the ties.
            in_order = order[kind[order] == 1]
            head = np.r_[True, s[in_order][1:] != s[in_order][:-1]]
            rank[in_order] = np.maximum.accumulate(np.where(head, rank[in_order], 0))
            after = np.arange(n)
            after[new] = succ
            count = np.diff(np.r_[np.flatnonzero(head), len(in_order)])
            ties = in_order[np.repeat(count, count) > 1]
            while len(ties):
                far = rank[after[ties]]
                by = np.lexsort((far, rank[ties]))
                ties, far = ties[by], far[by]
                old = rank[ties]
                head = np.r_[True, old[1:] != old[:-1]]
                fresh = head | np.r_[True, far[1:] != far[:-1]]
                places = np.arange(len(ties))
                rank[ties] = old + np.maximum.accumulate(np.where(fresh, places, 0)) - np.maximum.accumulate(np.where(head, places, 0))
                after[new] = after[after[new]]
                count = np.diff(np.r_[np.flatnonzero(fresh), len(ties)])
                ties = ties[np.repeat(count, count) > 1]
            order = np.argsort(rank)
        low = np.full(n, CAP, np.uint8)
        s, kind = s[order], kind[order]
        first = np.r_[True, s[1:] != s[:-1]]
        is_new = (kind == 1) & ~first
        low[rank[:a]] = plus(s_a, l_a)
        low[rank[a:a + b]] = seed_low
        meet = np.flatnonzero((kind == 2) & ~first & (np.r_[0, kind[:-1]] < 2))  # a seed behind an induced suffix
        low[meet] = shared(self.text, self.place(pos[order[meet - 1]]), self.place(pos[order[meet]]))
        heads, last = s[first], state["symbol"]
        steps = heads[:-1] + 1 if last is None else np.r_[last + 1, heads[:-1] + 1]
        least = np.minimum.reduceat(before[:heads[-1] + 1], steps) if len(steps) else np.empty(0, np.uint8)
        low[first] = np.r_[np.uint8(0), least] if last is None else least
        state["symbol"] = int(heads[-1])
        at = np.flatnonzero(is_new)
        if len(at):
            own = rank[succ[order[at] - a - b]]  # place of the successor
            behind_new = kind[at - 1] == 1
            left = np.zeros(len(at), np.int64)
            left[behind_new] = rank[succ[order[at[behind_new] - 1] - a - b]] + 1
            outside = np.where(behind_new, CAP, carry[s[at]])
            while True:  # a common prefix rests on earlier and shorter ones
                value = plus(s[at], np.minimum(outside, Least(low)(left, own)))
                if np.array_equal(value, low[at]):
                    break
                low[at] = value
        return pos[order], low, kind < 2


def suffix_order(strings: list[bytes], rows: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all strings in order: their places in the concatenation, common prefixes with the one
    before (bytes, up to CAP), and the concatenation itself (bytes as 1 to 256, 0 behind each string)."""
    scratch = Scratch(rows)
    text = scratch.empty(sum(map(len, strings)) + len(strings), np.int16)
    at = 0
    for x in strings:
        text[at:at + len(x)] = np.frombuffer(x, np.uint8)
        text[at:at + len(x)] += 1
        text[at + len(x)] = 0
        at += len(x) + 1
    size = np.ones(257, np.int64)
    size[0] = 0
    pos, low = Level(text, 257, size, np.zeros(257, np.uint8), None, text, scratch).order()
    return pos, low, text
