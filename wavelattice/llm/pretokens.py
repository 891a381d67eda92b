"""Pre-tokenisation of byte-level BPE by codepoint classes and an associative scan of transition functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

# Classes of code points. A1 and A2 are apostrophes before a contraction of one or two letters.
LETTER, NUMBER, OTHER, SPACE, WHITE, A1, A2, END = range(8)
# States after a code point. FRESH: whatever follows starts a new slice. ONE_LEFT, TWO_LEFT: inside a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE, ONE_LEFT, TWO_LEFT = range(8)

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """The class of every code point, built once in a process from Unicode's general categories."""
    global _classes
    if _classes is None:
        initials = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
        table = np.full(0x110000, OTHER, np.uint8)
        table[initials == ord("L")] = LETTER
        table[initials == ord("N")] = NUMBER
        table[WHITE_SPACE] = WHITE
        table[0x20] = SPACE
        _classes = table
    return _classes


def probed_table(joined: Callable[[list[str]], list[bool]]) -> np.ndarray:
    """``class_table`` with the code points that this Python's Unicode does not know classed as a library splits them.

    A letter joins the letter before it, a number the number: ``joined`` says of two-letter texts whether each is one
    slice. No version of Unicode so far has letters or numbers from 0x34000 up.
    """
    unknown = np.array([c for c in range(0x34000) if unicodedata.category(chr(c)) == "Cn"])
    table = class_table().copy()
    for cls, before in ((LETTER, "a"), (NUMBER, "1")):
        table[unknown[np.array(joined([before + chr(c) for c in unknown]), bool)]] = cls
    return table


def transition_table() -> np.ndarray:
    """``TRANSITION[class, state]``: the state after a code point of that class."""
    plain = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, END: FRESH}
    table = np.empty((8, 8), np.uint8)
    for cls in range(8):
        for state in range(8):
            if cls == END:
                after = FRESH
            elif state == TWO_LEFT:
                after = ONE_LEFT
            elif state == ONE_LEFT:
                after = FRESH
            elif cls in (A1, A2):
                # A space or a run of other signs takes the apostrophe in; elsewhere it opens a contraction.
                after = IN_OTHER if state in (AFTER_SPACE, IN_OTHER) else (ONE_LEFT if cls == A1 else TWO_LEFT)
            else:
                after = plain[cls]
            table[cls, state] = after
    return table


TRANSITION = transition_table()


def classes_of(points: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Class of each code point (by ``table``); apostrophes look at the two code points behind them."""
    found = (class_table() if table is None else table)[points]
    at = np.flatnonzero(points[:-1] == ord("'"))
    if at.size:
        one = points[at + 1]
        two = points[np.minimum(at + 2, points.size - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = (
            ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        ) & (at + 2 < points.size)
        found[at[single]] = A1
        found[at[double]] = A2
    return found


def scan_states(classes: np.ndarray, width: int = 256) -> np.ndarray:
    """State after every code point, by composing transition functions.

    The array is cut into rows of ``width``. Every row's function (state in, state out) is composed column by column,
    all rows at once, until every row's function is constant, as is usual after a few columns: from there on one state
    a row stands for all. The rows' functions are combined by a doubling prefix scan, which is right because
    composition is associative; then each row replays its first columns from its entry state.
    """
    n = classes.size
    if not n:
        return np.empty(0, np.uint8)
    rows = -(-n // width)
    padded = np.full(rows * width, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    columns <<= 3
    flat = TRANSITION.ravel()
    out = np.empty((width, rows), np.uint8)
    whole = np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, rows))
    settled = 0
    while settled < width:
        whole = flat[columns[settled] | whole]
        settled += 1
        if (whole == whole[0]).all():
            break
    state = whole[0]
    for j in range(settled, width):
        state = out[j] = flat[columns[j] | state]
    if settled < width:
        whole = np.broadcast_to(state, (8, rows))
    step = 1
    while step < rows and not (whole == whole[0]).all():
        # The function of the rows before is applied first, then the row's own.
        combined = np.take_along_axis(whole[:, step:], whole[:, :-step].astype(np.intp), axis=0)
        whole = np.concatenate([whole[:, :step], combined], axis=1)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0] = FRESH
    state[1:] = whole[FRESH, :-1]
    for j in range(settled):
        state = out[j] = flat[columns[j] | state]
    return out.T.reshape(-1)[:n]


def slice_starts(points: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Sorted starts of the slices of texts laid end to end, a separator (any code point) behind each.

    ``ends``: position of each text's separator. Separators come out as slices of their own. ``table``: the class of
    every code point, where it is another than this Python's.
    """
    n = points.size
    classes = classes_of(points, table)
    # An apostrophe's look-ahead must not cross a separator.
    for back, kinds in ((1, (A1, A2)), (2, (A2,))):
        at = ends[ends >= back] - back
        if at.size:
            at = at[np.isin(classes[at], kinds)]
            classes[at] = OTHER
    classes[ends] = END
    state = scan_states(classes)
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = state[:-1]
    white = (classes == SPACE) | (classes == WHITE)
    white_before = (before == AFTER_SPACE) | (before == AFTER_WHITE)
    last_white = np.empty(n, bool)  # white, with something other than white or an end behind it
    last_white[:-1] = ~(white[1:] | (classes[1:] == END))
    last_white[-1] = False
    inside = (before == ONE_LEFT) | (before == TWO_LEFT)
    opens = ((state == ONE_LEFT) & ~inside) | (state == TWO_LEFT)
    start = np.where(
        white,
        ~white_before | last_white,
        np.where(white_before, before == AFTER_WHITE, ~inside & (opens | (before == FRESH) | (state != before))),
    )
    start[ends] = True
    start[ends[ends + 1 < n] + 1] = True
    start[0] = True
    return np.flatnonzero(start)


def slices(texts: list[str]) -> list[list[str]]:
    """The slices of each text; joined they give the text back."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = slice_starts(points, ends)
    stops = np.append(starts[1:], points.size)
    cut = np.searchsorted(starts, ends)  # index of each separator's own slice
    a, b, out, at = starts.tolist(), stops.tolist(), [], 0
    for k in cut.tolist():
        out.append([joined[x:y] for x, y in zip(a[at:k], b[at:k], strict=True)])
        at = k + 1
    return out
