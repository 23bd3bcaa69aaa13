"""Edit distances that Spark has no function for. Both sides arrive in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType


def _edit(a, b, free_start: bool = False) -> int:
    """Levenshtein distance of two sequences; with ``free_start`` of ``a`` to the nearest stretch of ``b``."""
    row = _last_row(a, b, free_start)
    return int(row.min() if free_start else row[-1])


def _last_row(a, b, free_start: bool = False) -> np.ndarray:
    """For each end in ``b`` the distance of ``a`` to what is before it, or with ``free_start`` to the nearest stretch ending there.

    One row at a time in NumPy: insertions along the row are a running minimum."""
    codes: dict = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in s], np.int64) for s in (a, b))
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64) if free_start else steps.copy()
    for i, x in enumerate(a, 1):
        best = np.r_[i, np.minimum(row[:-1] + (b != x), row[1:] + 1)]
        row = np.minimum.accumulate(best - steps) + steps
    return row


def _letters(a, begin: int, end: int) -> dict:
    """For each item of ``a`` the places where it stands between ``begin`` and ``end``, as the bits of a number (bit 0: ``begin``)."""
    places: dict = {}
    for i in range(max(begin, 0), min(end, len(a))):
        places.setdefault(a[i], []).append(i - begin)
    out = {}
    for x, own in places.items():
        bits = bytearray(own[-1] // 8 + 1)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _bits(a, b) -> int:
    """Levenshtein distance of two sequences, not empty: a column of differences in one integer (Myers, Hyyrö), a step for each item of ``b``."""
    at, every, last = _letters(a, 0, len(a)), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, far = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | every & ~(h | up), up & h
        far += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(v | more)) & every, more & v & every
    return far


def _banded(a, b, k: int) -> int:
    """The distance of ``a`` and ``b`` if it is at most ``k``, else some number above ``k``: only the 2k + 1 diagonals around the main one are worked out,
    as one integer that slides down by a row with each item of ``b``. 0 < k < len(a), and the lengths differ by k at most."""
    m, n, wide = len(a), len(b), 2 * k + 1
    every, top = (1 << wide) - 1, 2 * k
    up, down, far = every >> k << k, 0, k
    strip, turn = max(wide, 256), min(m - k, n)
    for begin in range(0, n, strip):
        at = _letters(a, begin - k, begin + strip + k)
        end = min(begin + strip, n)
        for off, c in enumerate(b[begin : min(end, max(begin, turn))]):  # down the lowest diagonal, until it meets the last row
            same = at.get(c, 0) >> off
            d = ((((same & up) + up) ^ up) | same | down) & every
            more = down | (every ^ (d | up))
            less = d & up
            d >>= 1
            far += not d >> (top - 1)
            up, down = less | (every ^ (d | more)), d & more
        for j in range(max(begin, turn), end):  # along the last row
            same = at.get(b[j], 0) >> (j - begin)
            d = ((((same & up) + up) ^ up) | same | down) & every
            more = down | (every ^ (d | up))
            less = d & up
            bit = m - 1 - j + k
            far += (more >> bit & 1) - (less >> bit & 1)
            d >>= 1
            up, down = less | (every ^ (d | more)), d & more
    return far


def _alike(a, b, i: int, j: int) -> int:
    """How many items of ``a`` from ``i`` on are those of ``b`` from ``j`` on: steps that double, then halve."""
    n, step = 0, 8
    most = min(len(a) - i, len(b) - j)
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    while step and n < most:
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        step //= 2
    return min(n, most)


DIAGONALS = 6
SLACK = 16  # as many edits above what the items of both sides tell are looked for by narrow waves
ROOTS = 3  # as many square roots of a text's length are the edits that wide waves go up to; beyond, bands take less time


def _few(a, b, most: int) -> tuple[int | None, int]:
    """(distance, furthest place in ``a``) by the furthest-reaching points of the diagonals, as long as ``most`` edits are enough; else (None, place)."""
    goal = len(b) - len(a)
    reach = {0: _alike(a, b, 0, 0)}
    for d in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return d, len(a)
        if d == most:
            break
        now = {}
        for k in range(-d - 1, d + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i < 0 or i + k < 0:
                continue
            i = min(i, len(a), len(b) - k)
            if i >= 0:
                now[k] = i + _alike(a, b, i, i + k)
        reach = now
    return None, max(reach.values())


LONGEST = 1 << 21  # items of a text that waves are worked out for; they take 12 bytes each
TOGETHER = 1 << 20  # items of the texts that waves are worked out for at once; a longer text is worked on alone
_STEPS = (16, 64)  # numbers of codes that are looked at at once where many are alike: first, then
_END = 8  # places behind a text
_NOWHERE = -1 << 40  # no place
_ITEMS = 0xFFFE  # as many different items can be told apart


def _coded(pairs: list) -> tuple[list[tuple[np.ndarray, np.ndarray]], int] | None:
    """The sequences of each pair as small numbers, equal where their items are, and how many numbers there are; None if they are too many."""
    if isinstance(pairs[0][0], str):
        flat = np.frombuffer("".join(x for pair in pairs for x in pair).encode("utf-32-le", "surrogatepass"), np.uint32)
        if flat.max() < 1 << 16:
            seen = np.zeros(1 << 16, bool)
            seen[flat] = True
            flat, many = (np.cumsum(seen) - 1)[flat], int(seen.sum())
        else:
            own, flat = np.unique(flat, return_inverse=True)
            many = len(own)
        cut = np.split(flat, np.cumsum([len(x) for pair in pairs for x in pair])[:-1])
    else:
        cut, many = [], 0
        for pair in pairs:
            codes: dict = {}
            cut += [np.array([codes.setdefault(x, len(codes)) for x in s], np.int64) for s in pair]
            many = max(many, len(codes))
    return None if many > _ITEMS else (list(zip(cut[::2], cut[1::2])), many)


def _packed(codes: list[np.ndarray], bits: int) -> np.ndarray:
    """At each place the codes from there on, as many as one number holds."""
    out = np.concatenate(codes).astype(np.uint64)
    n = 1
    while n < 64 // bits:
        out[:-n] |= out[n:] << np.uint64(bits * n)  # twice as many codes
        n *= 2
    return out


def _same(unlike: np.ndarray, bits: int) -> np.ndarray:
    """How many codes are alike, from the lowest one on; ``unlike``: the bits in which two numbers of them differ."""
    return np.bitwise_count(~unlike & (unlike - np.uint64(1))) // np.uint8(bits)


def _ahead(a: np.ndarray, b: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of numbers, for each place of either side and its end: the first less the second is the least distance of what follows these places.

    It is by how much one side holds more of the items than the other which it holds more of in all, or the other way round; an edit changes that by 1 at most."""
    more = np.bincount(a, minlength=many) - np.bincount(b, minlength=many)
    weight = (more > 0).astype(np.int32) if more.sum() >= 0 else -(more < 0).astype(np.int32)
    return tuple(np.concatenate([np.cumsum(weight[s][::-1], dtype=np.int32)[::-1], np.zeros(_END, np.int32)]) for s in (a, b))


def _waves(pairs: list, slack: int, most: list[int]) -> list[int | None]:
    """The distances of pairs that are at most ``most``, which is less than the length of either side, and by at most ``slack`` above what the items of
    both sides tell; else None.

    For each number of edits the furthest places that are reached on all diagonals (Ukkonen, Myers), of all pairs at once: a row for each pair, a column for
    each diagonal. What is alike from there on is skipped eight items at a time, four if there are many. A place whose edits and least distance ahead are too many is left out: of the
    shortest ways one goes along furthest places, and none of these is."""
    found: list[int | None] = [None] * len(pairs)
    made = _coded(pairs)
    if made is None:
        return found
    sides, many = made
    bits = 8 if many < 255 else 16  # of a code; the two highest ones end either side
    whole = 64 // bits
    ends = [np.full(_END, (1 << bits) - 2 + n) for n in (0, 1)]
    steps = [whole * np.arange(n) for n in _STEPS]
    left, right = (_packed([x for pair in sides for x in (pair[n], ends[n])] + [np.zeros(64 * max(_STEPS), np.int64)], bits) for n in (0, 1))
    ahead = [_ahead(a, b, many) for a, b in sides]
    least = np.array([int(x[0]) - int(y[0]) for x, y in ahead])
    ahead_left, ahead_right = (np.concatenate([x[n] for x in ahead]) for n in (0, 1))
    m, n = (np.array([len(pair[side]) for pair in sides]) for side in (0, 1))
    begin_left, begin_right = (np.cumsum(x + _END) - x - _END for x in (m, n))
    end_left, end_right = begin_left + m, begin_right + n
    row, end, shift, goal, most = np.arange(len(pairs)), begin_left + m, begin_right - begin_left, n - m, np.minimum(np.array(most), least + slack)
    ahead_left -= np.repeat(most, m + _END)  # what follows a place is compared with what is left of a row's edits
    d, look, wide, base = 0, 0, 1, np.zeros(len(pairs), np.int64)
    now = begin_left[:, None].copy()  # places on the left; those on the right lie shift + diagonal further
    while True:
        if d == look:  # rows that are done go; the others get room on either side of their diagonals
            live, column = np.nonzero(now >= 0)
            if not len(live):
                return found
            first = np.flatnonzero(np.diff(live, prepend=-1))
            keep, low, high = live[first], column[first], column[np.append(first[1:], len(column)) - 1]
            if 4 * len(keep) < 3 * len(row) or low.min() < 2 or high.max() > wide - 3:
                width = int((high - low).max()) + 1
                wide = width + max(24, width // 2)
                move = np.zeros(len(row), np.int64)
                move[keep] = (wide - 1) // 2 - (low + high) // 2
                line = np.zeros(len(row), np.int64)
                line[keep] = np.arange(len(keep))
                moved = np.full((len(keep), wide), _NOWHERE)
                moved[line[live], column + move[live]] = now[live, column]
                now, base = moved, (base - move)[keep]
                row, end, shift, goal, most = (x[keep] for x in (row, end, shift, goal, most))
                diagonal = base[:, None] + np.arange(wide)
                across, off = (shift[:, None] + diagonal).ravel(), (np.abs(goal[:, None] - diagonal) - most[:, None]).ravel()
                last = np.minimum(end[:, None], end[:, None] + goal[:, None] - diagonal)
                places, far = now.ravel(), np.empty((len(keep), wide - 2), np.int64)
                there = np.where((goal >= base) & (goal < base + wide), goal - base, 0) + np.arange(len(keep)) * wide  # the first column is empty
                low, high = low + move[keep], high + move[keep]
            look = d + max(1, min(int(low.min()), wide - 1 - int(high.max())) - 1)
        if d:
            np.maximum(now[:, 1:-1], now[:, 2:], out=far)
            far += 1
            np.maximum(far, now[:, :-2], out=now[:, 1:-1])
            np.minimum(now, last, out=now)
        some = np.flatnonzero(now >= 0)
        if not len(some):
            return found
        at, past = places[some], across[some]
        same = _same(left[at] ^ right[at + past], bits)
        at += same
        on, step = np.flatnonzero(same == whole), steps[0]
        while len(on):
            here = at[on, None] + step
            unlike = left[here] ^ right[here + past[on, None]]
            until = (unlike != 0).argmax(axis=1)
            same = _same(unlike[np.arange(len(on)), until], bits)
            more = (until == 0) & (same == whole)
            at[on] += np.where(more, whole * len(step), whole * until + same)
            on, step = on[more], steps[1]
        alive = np.maximum(ahead_left[at] - ahead_right[at + past], off[some]) <= -d
        now.fill(_NOWHERE)
        places[some[alive]] = at[alive]
        done = np.flatnonzero(places[there] == end)
        if len(done):
            for r in row[done].tolist():
                found[r] = d
            now[done] = _NOWHERE
        d += 1


def _rest(a, b, k: int) -> int:
    """The distance of ``a`` and ``b``, not empty: bands from ``k`` on are doubled until one holds it."""
    if not isinstance(a, str):  # what one side has more often than the other needs an edit each
        k = max(k, 5 * (max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values())) // 4)
    while k < len(a) // 2:
        far = _banded(a, b, k)
        if far <= k:
            return far
        k *= 2
    return _bits(a, b)


def _roots(length: int) -> int:
    return int(ROOTS * length ** 0.5)


def _together(pairs: list, slack: int, most: Callable[[int], int], found: list[int]) -> list:
    """Puts distances that waves find where they belong; the pairs, (shorter length, place, either side), that are left."""
    left, begin = [], 0
    while begin < len(pairs):
        end, size = begin, 0
        while end < len(pairs) and (end == begin or size + pairs[end][0] <= TOGETHER):
            size += pairs[end][0]
            end += 1
        some, begin = pairs[begin:end], end
        for pair, far in zip(some, _waves([p[2:] for p in some], slack, [most(p[0]) for p in some])):
            if far is None:
                left.append(pair)
            else:
                found[pair[1]] = far
    return left


def all_edits(pairs: list) -> list[int]:
    """Levenshtein distances of pairs of sequences (texts or lists of words), in a time that follows length times edits at most: what both begin and end with
    costs nothing. Waves go first, narrow ones as far as the items of both sides tell the distance nearly, wide ones where edits are few for the length;
    for what is left bands are doubled until one holds the distance."""
    found, waves, hard = [0] * len(pairs), [], []
    for p, (a, b) in enumerate(pairs):
        if a == b:
            continue
        head = _alike(a, b, 0, 0)
        a, b = a[head:], b[head:]
        tail = _alike(a[::-1], b[::-1], 0, 0)
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        short, long = sorted((len(a), len(b)))
        if not short:
            found[p] = long
        elif short <= 128:
            found[p] = _bits(a, b)
        else:
            (hard if long > LONGEST else waves).append((short, p, a, b))
    wide = []
    for pair in hard + _together(sorted(waves, key=lambda w: w[0]), SLACK, lambda n: n - 1, found):
        short, p, a, b = pair
        far, reached = _few(a, b, DIAGONALS)
        k = max(64, abs(len(a) - len(b)) + 16, 4 * DIAGONALS * len(a) // max(1, reached))
        if far is not None:
            found[p] = far
        elif k <= 4 * _roots(short) and max(len(a), len(b)) <= LONGEST:
            wide.append(pair)
        else:
            found[p] = _rest(a, b, k)
    for short, p, a, b in _together(wide, 1 << 40, _roots, found):
        found[p] = _rest(a, b, max(64, abs(len(a) - len(b)) + 16, 2 * _roots(short)))
    return found


def edits(a, b) -> int:
    """Levenshtein distance of two sequences (texts or lists of words)."""
    return all_edits([(a, b)])[0]


def _units(t: str) -> int:
    """Length in UTF-16 units, as rates are defined on."""
    return len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2


def _plain_sides(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    import unicodedata

    from quire.functions import markup

    return [(unicodedata.normalize("NFC", r).replace("\r\n", "\n").replace("\r", "\n").strip(markup.SPACES),
        unicodedata.normalize("NFC", markup.plain(p)).strip(markup.SPACES)) for r, p in pairs]


_normal_batch: list[list] = [[], []]  # pairs of the last batch in this worker, and what became of them: a query may show edits of normalized texts and of their words


def _normal_sides(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    from quire.functions import markup

    if pairs != _normal_batch[0]:
        _normal_batch[:] = pairs, [(markup.normal(r), markup.normal(p)) for r, p in pairs]
    return _normal_batch[1]


def _word_sides(pairs: list[tuple[str, str]]) -> list[tuple[list[str], list[str]]]:
    return [tuple(t.split(" ") if t else [] for t in pair) for pair in _normal_sides(pairs)]


def _edits_of(names: tuple[str, str, str], sides: Callable[[list], list], length: Callable[..., int]) -> Callable[..., Column]:
    """A column of edits and both lengths, under these names, of pairs of texts, null as empty."""

    def run(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        pairs = sides([(x or "", y or "") for x, y in zip(reference, prediction)])
        rows = [(d, length(r), length(p)) for d, (r, p) in zip(all_edits(pairs), pairs)]
        return pd.DataFrame(rows, columns=list(names), dtype="int64")

    run.__annotations__ = {"reference": pd.Series, "prediction": pd.Series, "return": pd.DataFrame}
    return pandas_udf(run, StructType([StructField(c, LongType()) for c in names]))


#: edits and lengths of the plain texts, of the normalized ones, and of their words; the prediction is Markdown. A query works out those it shows
plain_edits = _edits_of(("d", "n_r", "n_p"), _plain_sides, _units)
normal_edits = _edits_of(("nd", "n_nr", "n_np"), _normal_sides, _units)
word_edits = _edits_of(("wd", "wr", "wp"), _word_sides, len)


def _stretches(needle: str, text: str, most: int) -> list[tuple[int, int]]:
    """Ranges of ``text`` that hold every stretch within ``most`` edits of ``needle``: of most + 1 pieces of it one is left unharmed."""
    m, pieces = len(needle), most + 1
    if m < pieces:
        return [(0, len(text))]
    found = []
    for i in range(pieces):
        a, b = m * i // pieces, m * (i + 1) // pieces
        at = text.find(needle[a:b])
        while at >= 0:
            found.append((max(0, at - a - most), min(len(text), at - a + m + most)))
            at = text.find(needle[a:b], at + 1)
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((begin, end))
    return merged


def _ends(needle: str, text: str, most: int) -> np.ndarray:
    """Where stretches of ``text`` within ``most`` edits of ``needle`` end, 0 to its length, in order."""
    ends = [begin + np.flatnonzero(_last_row(needle, text[begin:end], True) <= most) for begin, end in _stretches(needle, text, most)]
    ends += [np.zeros(1, np.int64)] if len(needle) <= most else []
    return np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


@pandas_udf(BooleanType())
def found_within(needle: pd.Series, text: pd.Series, most: pd.Series) -> pd.Series:
    """Whether some stretch of ``text`` is within ``most`` edits of ``needle``."""
    return pd.Series([bool(len(_ends(x or "", t or "", int(k)))) for x, t, k in zip(needle, text, most)], dtype=bool)


def _starts(needle: str, text: str, most: int) -> np.ndarray:
    """Where stretches of ``text`` within ``most`` edits of ``needle`` start, last first; none starts at its end. Tests hold :func:`_start` against it."""
    ends = _ends(needle[::-1], text[::-1], most)
    return len(text) - ends[ends > 0]


def _end(needle: str, text: str, most: int, last: bool, strip: int = 256) -> int | None:
    """The first or the ``last`` place behind the beginning of ``text`` where a stretch within ``most`` edits of ``needle`` ends: looked for strip by strip from
    that side, so that what lies beyond it isn't worked out. A strip reads as far back as a stretch can begin."""
    back = len(needle) + most
    stretches = _stretches(needle, text, most)
    for begin, end in reversed(stretches) if last else stretches:
        strips = range(begin, end, strip)
        for at in reversed(strips) if last else strips:
            low, high = max(begin, at - back), min(end, at + strip)
            ends = low + np.flatnonzero(_last_row(needle, text[low:high], True) <= most)
            ends = ends[ends > at]
            if len(ends):
                return int(ends[-1] if last else ends[0])
    return None


def _start(needle: str, text: str, most: int, last: bool) -> int | None:
    """The first or the ``last`` place where a stretch of ``text`` within ``most`` edits of ``needle`` starts; none starts at its end."""
    end = _end(needle[::-1], text[::-1], most, not last)
    return None if end is None else len(text) - end


@pandas_udf(BooleanType())
def starts_before(before: pd.Series, after: pd.Series, text: pd.Series, most: pd.Series) -> pd.Series:
    """Whether the first start of ``before`` lies before the last start of ``after``, both within ``most`` edits."""
    out = []
    for x, y, t, k in zip(before, after, text, most):
        first = _start(x or "", t, int(k), False) if t else None
        last = None if first is None else _start(y or "", t, int(k), True)
        out.append(last is not None and first < last)
    return pd.Series(out, dtype=bool)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: the rows of a column in one integer (Hyyrö), a step for each character of ``b``."""
    at, every = _letters(a, 0, len(a)), (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def _indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths; 1 for two empty texts."""
    return 1.0 if a == b else 2.0 * _common(a, b) / (len(a) + len(b))


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * longest common subsequence / both lengths; 1 for two empty texts."""
    return pd.Series([_indel_ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def _all_close(pairs: pa.Array, most: pa.Array) -> pa.Array:
    known: dict = {}
    out = []
    for own, k in zip(pairs.to_pylist(), most.to_pylist()):
        if own is None:
            out.append(None)
            continue
        ok = True
        for p in own:
            want = p["want"] or ""
            least = max(0.5, 1 - k / max(len(want), 1))
            for got in p["got"] or ():
                if got is not None:
                    ratio = known.get((want, got))
                    if ratio is None:
                        ratio = known[want, got] = _indel_ratio(want, got)
                    if ratio >= least:
                        break
            else:
                ok = False
                break
        out.append(ok)
    return pa.array(out, pa.bool_())


#: whether each pair (want, texts got) has a text of an indel ratio of 1 - most / length of want, 0.5 at least
all_close = arrow_udf(_all_close, BooleanType())


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
