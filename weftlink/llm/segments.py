"""Cuts texts where no byte-level pre-token can cross, so that each distinct piece of text is encoded once.

A pre-token that starts in other characters ends before white space, hence a text may be cut before every ASCII white
space that follows another character. It may also be cut after a run of letters that an ASCII character ends; that is
done for the first run of a stretch between white space. Texts with white space beyond ASCII are left whole.

The work is done on Arrow buffers: cuts are found by passes over the bytes of many texts at once, distinct segments by
Arrow's hash tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _marks(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SPACE = _marks([32, *range(9, 14)])
_LETTER = _marks([*range(65, 91), *range(97, 123)])
#: After C3: the letters of U+00C0-00FF, where U+00D7 and 00F7 are none.
_AFTER_C3 = _marks([*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
_SPACE_LEAD = _marks([0xC2, 0xE1, 0xE2, 0xE3])
#: UTF-8 forms of the white space beyond ASCII, as lead, second and third byte: U+1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
_LONG_SPACES = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, and where each text starts in them, with the end."""
    _, ends, data = texts.buffers()
    wide = pa.types.is_large_binary(texts.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binary(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """A large binary array of the stretches between the places `at`."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _with_other_spaces(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the texts that hold white space beyond ASCII."""
    lead = np.flatnonzero(_SPACE_LEAD[raw])
    lead = lead[lead + 1 < len(raw)]
    second, third = raw[lead + 1].astype(np.int64), raw[np.minimum(lead + 2, len(raw) - 1)].astype(np.int64)
    code = (raw[lead].astype(np.int64) << 16) | (second << 8) | third
    found = lead[((raw[lead] == 0xC2) & ((second == 0x85) | (second == 0xA0))) | np.isin(code, _LONG_SPACES)]
    return np.unique(np.searchsorted(at, found, side="right") - 1)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts, one after the other, and the number of segments of each text."""
    raw, at = content(texts)
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    firsts = at[:-1][at[1:] > at[:-1]]
    space = _SPACE[raw]
    edge = np.empty(len(raw), bool)
    edge[0] = True
    edge[1:] = space[1:] & ~space[:-1]
    edge[firsts] = True
    starts = np.flatnonzero(edge)
    # the first run of letters in each stretch, found through the count of other bytes before it
    letter = _LETTER[raw]
    c3 = np.flatnonzero(raw[:-1] == 0xC3)
    c3 = c3[_AFTER_C3[raw[c3 + 1]]]
    letter[c3] = letter[c3 + 1] = True
    spaces_before = np.cumsum(space, dtype=np.int32)
    others = np.flatnonzero(~space)
    place = starts - spaces_before[starts] + space[starts]
    begin = others[np.minimum(place, len(others) - 1)] if len(others) else starts
    stops = np.append(starts[1:], len(raw))
    inside = (begin >= starts) & (begin < stops) & (place < len(others))
    begin = begin[inside]
    stops = stops[inside]
    ends = np.flatnonzero(~letter)
    ends_before = np.cumsum(~letter, dtype=np.int32)
    place = ends_before[begin] - ~letter[begin]
    end = ends[np.minimum(place, len(ends) - 1)] if len(ends) else stops
    end = end[(place < len(ends)) & (end > begin) & (end < stops) & (raw[np.minimum(end, len(raw) - 1)] < 0x80)]
    edge[end] = True
    for i in _with_other_spaces(raw, at).tolist():
        edge[at[i] + 1 : at[i + 1]] = False
    starts = np.flatnonzero(edge)
    counts = np.diff(np.searchsorted(starts, at))
    return binary(raw, np.append(starts, len(raw))), counts


def begin_in_space(segments: pa.Array) -> np.ndarray:
    """Marks segments that begin with ASCII white space and end with another character: no pre-token crosses from one into the next."""
    raw, at = content(segments)
    out = _SPACE[raw[at[:-1]]] & ~_SPACE[raw[at[1:] - 1]]
    out[_with_other_spaces(raw, at)] = False
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The runs of bytes other than ASCII white space, ASCII letters lower-cased if asked.

    Gives each word's number, the distinct words in the order of their first appearance, and the number of words of each text.
    """
    raw, at = content(texts)
    if not len(raw):
        return np.empty(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = at[:-1][at[1:] > at[:-1]]
    first[starts] = solid[starts]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.large_binary()), counts
    edges = np.append((np.cumsum(solid, dtype=np.int64) - 1)[starts], int(solid.sum()))
    raw = raw[solid]
    coded = pc.dictionary_encode(binary(_LOWER[raw] if lower else raw, edges))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


class Known:
    """Distinct segments, numbered from 0 in the order in which they were first met, in one Arrow array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.values = pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.values)

    def number(self, segments: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Each segment's number, and the new ones, whose numbers follow those known before."""
        coded = pc.dictionary_encode(segments)
        at = pc.index_in(coded.dictionary, value_set=self.values)
        lacks = pc.is_null(at)
        new = coded.dictionary.filter(lacks)
        numbers = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers[lacks.to_numpy(zero_copy_only=False)] = len(self.values) + np.arange(len(new))
        if len(new):
            self.values = pa.concat_arrays([self.values, new])
        return numbers[coded.indices.to_numpy(zero_copy_only=False)], new
