"""Best-fit packing (6) by bin completion.

Documents become token ids and an end id; a document longer than a sequence is
cut into full pieces and a rest.  Full pieces are sequences of their own.  The
rests are dealt at random into groups of about ``group`` pieces, so that a
task's work and memory are bounded and no key can grow hot, and each group is
packed by itself: at most one sequence of a group stays partly empty in excess
of what one global packing would have, 1 in thousands.

A group is a histogram of lengths.  Best-fit decreasing gives the incumbent.
Where it uses more bins than a lower bound asks for, branch and bound takes
over: the largest length left is put in a bin, the bin's undominated
completions (no lengths of them can be exchanged for one that is left, fills
more and still fits) are tried by waste, each as often as its lengths are left
and once, and a branch is cut when the waste so far rules out a better packing
than the incumbent.  The completions are enumerated one at a time, with no bound
of their own; what bounds the search is ``nodes``, the fillings taken besides
one for each distinct length, and ``WORK``, the fillings looked at in a group.  Where it runs out, the incumbent stands: the gap is the bins it has
over ``least_bins``.

Defined cases: null text counts as empty, one end id; texts of any length are
read whole; repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import run_ids
from tessera.session import cut

SEQUENCE, GROUP, NODES, OPEN_BINS, WORK = 2048, 16384, 600, 48, 150_000

def pieces(documents: DataFrame, tokenizer: str, *, size: int = SEQUENCE, text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut_up(batches):
        ids = run_ids(tokenizer)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, data in enumerate(ids.encode(b.column(1).to_pylist())):
                data = memoryview(data)
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    row.append(r), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", F.col(text_col).cast("binary").alias("t")).mapInArrow(
        cut_up, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing over lengths; bins of lengths."""
    room: list[int] = []  # sorted distinct free spaces
    at: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, x)
        if i == len(room):
            bins.append([x])
            k, left = len(bins) - 1, size - x
        else:
            r = room[i]
            k = at[r].pop()
            if not at[r]:
                del at[r]
                room.pop(i)
            bins[k].append(x)
            left = r - x
        if left:
            if left not in at:
                at[left] = []
                insort(room, left)
            at[left].append(k)
    return bins


def completions(first: int, kinds: list[int], left: Counter, size: int, most_waste: int, work: list[int] | None = None):
    """All undominated fillings of a bin around ``first``, least waste first, one at a time.

    kinds: the distinct lengths left, rising.  ``reach[i]`` has a bit for every
    sum that lengths up to ``kinds[i]`` can make, so a filling of a given sum is
    found without a dead end, and every one of them is.  A filling is dominated
    if some of its lengths together (one: by a longer one; several: by one as
    long or longer) can be exchanged for one length that is left and still fits.
    ``work`` holds what may still be spent (a filling looked at: 1 and more);
    where it is used up, the enumeration ends.
    """
    work = [1 << 60] if work is None else work
    room = size - first
    inside = (1 << (room + 1)) - 1
    free = {x: left[x] - (x == first) for x in kinds if x <= room and left[x] > (x == first)}
    have = list(free)
    reach, sums = [], 1
    for x in have:
        n, step = min(free[x], room // x), 1
        while n > 0:  # n times x as steps of 1, 2, 4, ...
            k = min(step, n)
            sums |= sums << (k * x)
            n, step = n - k, 2 * step
        sums &= inside
        reach.append(sums)

    def spell(total: int, upto: int):
        """Fillings of exactly ``total``, the longest lengths first."""
        if total == 0:
            yield []
            return
        for i in range(upto, -1, -1):
            if not reach[i] >> total & 1:
                return
            x = have[i]
            for k in range(min(free[x], total // x), 0, -1):
                rest = total - k * x
                if rest == 0 or i and reach[i - 1] >> rest & 1:
                    for more in spell(rest, i - 1):
                        yield [x] * k + more

    work[0] -= len(have) >> 6
    every = sum(1 << x for x in have)
    for waste in range(min(room, most_waste) + 1):
        if have and reach[-1] >> (room - waste) & 1 or waste == room:
            for chosen in spell(room - waste, len(have) - 1):
                work[0] -= 1 + (len(chosen) >> 3)
                if work[0] < 0:
                    return
                used = Counter(chosen)
                outside = every & ~sum(1 << x for x, n in used.items() if n == free[x])
                # parts: sums of some of the lengths; single ones must gain at least 1
                parts, several = 1, 0
                for x in chosen:
                    several |= (several << x) | ((parts & ~1) << x)
                    parts |= parts << x
                singles = sum(1 << x for x in used)
                fits = outside & ((1 << (waste + 1)) - 1)  # could still be added
                if not (fits or several & _below(outside, waste) or waste and singles & _below(outside >> 1, waste - 1)):
                    yield chosen


def _below(bits: int, reach: int) -> int:
    """The bits that lie at most ``reach`` below one of ``bits``, or at it."""
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        bits |= bits >> step
        done += step
    return bits


def least_bins(lengths: list[int], size: int) -> int:
    """A number of bins that no packing goes below: by the sum, and by what fits beside the lengths over half a bin."""
    have = Counter(lengths)
    x = np.array(sorted(have), dtype=np.int64)
    n = np.array([have[v] for v in x.tolist()], dtype=np.int64)
    best = -(-sum(lengths) // size)
    for k in [0, *x[2 * x <= size].tolist()]:
        alone, wide, rest = x > size - k, (x <= size - k) & (2 * x > size), (x >= k) & (2 * x <= size)
        over = int((x * n)[rest].sum()) - int(((size - x) * n)[wide].sum())  # what the room beside the wide ones cannot hold
        best = max(best, int(n[alone | wide].sum()) + max(0, -(-over // size)))
    return best


def pack_lengths(lengths: list[int], size: int = SEQUENCE, nodes: int = NODES) -> list[list[int]]:
    """Bins of lengths, as few as found: best-fit decreasing, then bin completion while that can still help.

    Where one bin is to be saved, the ``OPEN_BINS`` bins with most waste are
    packed anew, which is quick.  Where more are, or that saves none, all bins
    are taken together.  ``WORK`` bounds what one call spends in all.
    """
    full = [[x] for x in lengths if x >= size]
    rest = [x for x in lengths if x < size]
    best, bound, work = best_fit(rest, size), least_bins(rest, size), [WORK]
    few = len(best) == bound + 1
    while len(best) > bound and work[0] > 0:
        best.sort(key=sum)
        cut_at = OPEN_BINS if few else len(best)
        some = best[:cut_at]
        better = complete([x for b in some for x in b], some, size, nodes, work) + best[cut_at:]
        if len(better) == len(best) and (not few or len(best) <= OPEN_BINS):
            break
        few = len(better) < len(best) and len(better) == bound + 1
        best = better
    return full + best


def complete(rest: list[int], incumbent: list[list[int]], size: int, nodes: int, work: list[int]) -> list[list[int]]:
    """Branch and bound over bins; ``incumbent`` if no packing of fewer bins is found.

    A filling is taken as often as its lengths are left, which uses up one of
    them, or else once.  So a first packing of all lengths takes as many
    fillings as there are distinct lengths at most; ``nodes`` more are tried.
    """
    best, bound = incumbent, least_bins(rest, size)
    if len(best) <= bound:
        return best
    total, left, spent = sum(rest), Counter(rest), 0
    kinds = sorted(left)
    nodes += len(kinds)
    done: list[tuple[list[int], int]] = []
    stack: list = []  # each level spells out the fillings not yet tried
    waste = 0
    goal = len(best) - 1  # a packing must have so many bins at most to be better

    def take(filling: list[int], times: int) -> None:
        for x in filling:
            before = left[x]
            left[x] = before - times
            if left[x] == 0:
                kinds.pop(bisect_left(kinds, x))
            elif before == 0:
                insort(kinds, x)

    def choices():
        first = kinds[-1]
        for c in completions(first, kinds, left, size, goal * size - total - waste, work):
            f = [first, *c]
            times = min(left[x] // k for x, k in Counter(f).items())
            yield f, times
            if times > 1:
                yield f, 1

    descend = True
    while spent < nodes and work[0] > 0:
        if descend:
            if not kinds:
                best = [list(f) for f, m in done for _ in range(m)]
                goal = len(best) - 1
                if len(best) <= bound:
                    break
                descend = False
                continue
            stack.append(choices())
        if len(done) == len(stack):  # undo the level's last choice
            old, times = done.pop()
            take(old, -times)
            waste -= times * (size - sum(old))
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            descend = False
            if not stack:
                break
            continue
        filling, times = choice
        spent += 1
        take(filling, times)
        done.append((filling, times))
        waste += times * (size - sum(filling))
        descend = waste <= goal * size - total  # all the waste that a better packing can have
    return best


def place(length: np.ndarray, size: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of a group."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(length.tolist()):
        by.setdefault(x, []).append(i)
    bin_of, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for k, b in enumerate(pack_lengths(length.tolist(), size, nodes)):
        at = 0
        for x in b:
            i = by[x].pop()
            bin_of[i], offset[i] = k, at
            at += x
    return bin_of, offset


def pack(documents: DataFrame, tokenizer: str, *, size: int = SEQUENCE, group: int = GROUP, nodes: int = NODES, text_col: str = "text") -> DataFrame:
    """Every piece with the sequence it goes to and its place there."""
    p = cut(pieces(documents, tokenizer, size=size, text_col=text_col))
    n = p.count()
    groups = max(1, round(n / group))
    # a number of the stored row, not its id, deals the pieces: repeated ids do not meet in one group
    dealt = p.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def fill(t: pa.Table) -> pa.Table:
        bin_of, offset = place(t.column("length").to_numpy(), size, nodes)
        g = t.column("g")[0].as_py()
        return pa.table({**{c: t.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                         "sequence_id": pa.array(bin_of + (g << 40)), "offset": pa.array(offset)})

    return dealt.groupBy("g").applyInArrow(
        fill, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
