"""Tables in Arrow batches, one in each row: what lies beside and above their cells, worked out for many tables at once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 1 << 17  # places of the tables that are worked on at once; a larger table is worked on alone
SHOWN = 1 << 18  # texts in an array of headings
CELL = ("cell_id", "row_no", "col_no", "rows", "cols", "is_heading")


def pieces(batch: pa.RecordBatch, most: int = PLACES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` places."""
    lists = batch.column("cells")
    flat, offsets = lists.values, lists.offsets.to_numpy()
    places = np.concatenate([[0], np.cumsum(flat.field("rows").to_numpy().astype(np.int64) * flat.field("cols").to_numpy())])[offsets]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(places, places[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _pairs(line: np.ndarray, along: np.ndarray, table: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearer, further) cells that meet along the rows or columns ``line``."""
    order = np.lexsort((along, line, table))
    a, b = order[:-1], order[1:]
    meet = (table[a] == table[b]) & (line[a] == line[b]) & (cell[a] != cell[b])
    return cell[a[meet]], cell[b[meet]]


def _links(of: np.ndarray, other: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct others of each cell in order of their place, and where each cell's begin."""
    order = np.lexsort((other, col[other], row[other], of))
    of, other = of[order], other[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (other[1:] != other[:-1])
    of, other = of[new], other[new]
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(row)))]), other


def _walked(table: np.ndarray, row: np.ndarray, col: np.ndarray, text: list, heading: list) -> Iterator[tuple[int, list, list]]:
    """(cell, names above, names before) of tables without spans, row by row: only what stands above the current row is kept."""
    empty: tuple[list, list] = ([], [])
    columns: dict[int, tuple[list, list]] = {}
    last_table = last_row = None
    before = empty

    def with_own(seen: tuple[list, list], i: int) -> tuple[list, list]:
        names, far = seen
        far = far or [text[i]]
        if heading[i] and text[i] is not None:
            at = bisect_left(names, text[i])
            if at == len(names) or names[at] != text[i]:
                names = [*names[:at], text[i], *names[at:]]
        return names, far

    for i, t, r, c in zip(range(len(text)), table.tolist(), row.tolist(), col.tolist()):
        if t != last_table:
            columns, last_table, last_row = {}, t, None
        if r != last_row:
            before, last_row = empty, r
        above = columns.get(c, empty)
        yield i, above[0] or above[1], before[0] or before[1]
        columns[c], before = with_own(above, i), with_own(before, i)


class _Sets:
    """Sets of names of headings, or of cells where there is none, as numbers; what sets together or one more name make is worked out once. 0 is empty."""

    def __init__(self) -> None:
        self.sets: list[tuple[frozenset, bool]] = [(frozenset(), False)]  # names, and whether of headings
        self.numbers = {self.sets[0]: 0}
        self.made: dict[tuple, int] = {}

    def _number(self, names: frozenset, headings: bool) -> int:
        n = self.numbers.setdefault((names, headings), len(self.sets))
        if n == len(self.sets):
            self.sets.append((names, headings))
        return n

    def with_heading(self, n: int, name: str) -> int:
        made = self.made.get((n, name))
        if made is None:
            names, headings = self.sets[n]
            made = self.made[n, name] = self._number((names if headings else frozenset()) | {name}, True)
        return made

    def end(self, name: str | None) -> int:
        return self._number(frozenset((name,)), False)

    def together(self, numbers: list[int]) -> int:
        """Of all names of headings, of ends only if there are no headings."""
        key = tuple(sorted(set(numbers)))
        if len(key) == 1:
            return key[0]
        made = self.made.get(key)
        if made is None:
            headings = any(self.sets[n][1] for n in key)
            made = self.made[key] = self._number(frozenset().union(*(self.sets[n][0] for n in key if self.sets[n][1] == headings)), headings)
        return made


def _reached(order: np.ndarray, starts: np.ndarray, others: np.ndarray, text: list, heading: list, sets: _Sets) -> list[int]:
    """The names of the headings that each cell's links lead to, or of the cells where they end; ``order`` from the near end on. Most cells hand on what they are
    led to."""
    leads, found = [0] * len(text), [0] * len(text)
    starts, others = starts.tolist(), others.tolist()
    for i in order.tolist():
        begin, end = starts[i], starts[i + 1]
        if end - begin == 1:
            n = leads[others[begin]]
        else:
            n = sets.together([leads[o] for o in others[begin:end]]) if end > begin else 0
        found[i] = n
        if heading[i] and text[i] is not None:
            n = sets.with_heading(n, text[i])
        elif end == begin:
            n = sets.end(text[i])
        leads[i] = n
    return found


def around(batch: pa.RecordBatch, shown: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of the tables in ``batch``, with the lists ``shown``: of neighbours (up, down, left, right) and headings (top_heading, left_heading)."""
    lists = batch.column("cells")
    flat = lists.flatten()
    table = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    if not len(table):
        return
    entry, row, col, rows, cols, heading = (flat.field(c).to_numpy(zero_copy_only=False) for c in CELL)
    order = np.lexsort((col, row, entry, table))  # of the entries of one cell the first place comes first
    new = np.ones(len(order), bool)
    new[1:] = (table[order][1:] != table[order][:-1]) | (entry[order][1:] != entry[order][:-1])
    cell = np.empty(len(order), np.int64)
    cell[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    own = order[first]
    plain = len(own) == len(order) and bool((rows == 1).all() and (cols == 1).all())
    own_table, own_row, own_col = table[own], np.minimum.reduceat(row[order], first), np.minimum.reduceat(col[order], first)
    own_heading = np.logical_or.reduceat(heading[order].astype(bool), first)
    own_text = flat.field("text").take(pa.array(own))
    kinds = {c: flat.type.field(c).type for c in ("cell_id", "row_no", "col_no")}
    made: dict[str, pa.Array] = {}
    links: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if not plain or {"up", "down", "left", "right"} & set(shown):
        reach = rows.astype(np.int64) * cols
        e = np.repeat(np.arange(len(reach)), reach)
        within = np.arange(len(e)) - np.repeat(np.cumsum(reach) - reach, reach)
        y, x = row[e] + within // cols[e], col[e] + within % cols[e]
        near, far = _pairs(x, y, table[e], cell[e])
        links |= {"up": _links(far, near, own_row, own_col), "down": _links(near, far, own_row, own_col)}
        near, far = _pairs(y, x, table[e], cell[e])
        links |= {"left": _links(far, near, own_row, own_col), "right": _links(near, far, own_row, own_col)}
    for c in ("up", "down", "left", "right"):
        if c in shown:
            made[c] = pa.ListArray.from_arrays(pa.array(links[c][0], pa.int32()), own_text.take(pa.array(links[c][1])))

    def rows_of(at: np.ndarray | slice, top: pa.Array | None = None, left: pa.Array | None = None) -> pa.RecordBatch:
        picked = pa.array(at)
        out = [batch.column("doc_id").take(pa.array(own_table[at])), batch.column("table_no").take(pa.array(own_table[at])),
            *[pa.array(v[at], kinds[c]) for c, v in (("cell_id", entry[own]), ("row_no", own_row), ("col_no", own_col))], own_text.take(picked)]
        out += [{"top_heading": top, "left_heading": left}[c] if c.endswith("_heading") else made[c].take(picked) for c in shown]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "table_no", "cell_id", "row_no", "col_no", "text", *shown])

    everything = np.arange(len(own))
    if "top_heading" not in shown:
        yield rows_of(everything)
        return
    text, heads = own_text.to_pylist(), own_heading.tolist()
    if not plain:
        sets = _Sets()
        top, left = (np.array(_reached(np.lexsort((along, own_table)), *links[side], text, heads, sets)) for along, side in ((own_row, "up"), (own_col, "left")))
        lengths = np.array([len(names) for names, _ in sets.sets])
        size = np.cumsum(lengths[top] + lengths[left] + 1)
        begin = 0
        while begin < len(size):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SHOWN, "right")))
            few, at = np.unique(np.concatenate([top[begin:end], left[begin:end]]), return_inverse=True)
            both = pa.array([sorted(sets.sets[n][0], key=lambda x: (x is not None, x or "")) for n in few.tolist()], pa.list_(pa.string()))
            yield rows_of(everything[begin:end], both.take(pa.array(at[: end - begin])), both.take(pa.array(at[end - begin :])))
            begin = end
        return
    by_place = np.lexsort((own_col, own_row, own_table))
    walk = _walked(own_table[by_place], own_row[by_place], own_col[by_place], own_text.take(pa.array(by_place)).to_pylist(), own_heading[by_place].tolist())
    listed = lambda x: pa.array(x, pa.list_(pa.string()))
    begin, size, tops, lefts = 0, 0, [], []
    for i, a, b in walk:
        tops.append(a)
        lefts.append(b)
        size += len(a) + len(b) + 1
        if size > SHOWN:
            yield rows_of(by_place[begin : i + 1], listed(tops), listed(lefts))
            begin, size, tops, lefts = i + 1, 0, [], []
    if tops:
        yield rows_of(by_place[begin:], listed(tops), listed(lefts))
