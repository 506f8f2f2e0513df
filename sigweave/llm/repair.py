"""Texts read in a wrong encoding, put right with the place of every character kept."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import numpy as np

# byte 0x80-0x9f as windows-1252 shows it; bytes it leaves undefined stay control characters
_HIGH = {b: (bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)) for b in range(0x80, 0xA0)}
_TO_BYTE = {ch: chr(b) for b, ch in _HIGH.items()}
_C1 = {b: ord(ch) for b, ch in _HIGH.items() if ord(ch) != b}
_SPECIAL = "".join(re.escape(c) for c in _HIGH.values() if ord(c) > 0xFF)
_SPECIALS = re.compile(f"[{_SPECIAL}]")
# characters as bytes, once windows-1252's own are put back to theirs
# patterns begin with one class, which is looked for fast
_UTF8 = re.compile("[\xc2-\xf4](?:(?<=[\xc2-\xdf])[\x80-\xbf]|(?<=[\xe0-\xef])[\x80-\xbf]{2}|(?<=[\xf0-\xf4])[\x80-\xbf]{3})")
_UTF8_RUN = re.compile(f"{_UTF8.pattern}(?:{_UTF8.pattern})*")
_BYTES = re.compile("[\x80-\xff][\x80-\xff]*")
_C1_SIGN = re.compile("[\x80-\x9f]")
_SUSPECT = re.compile(f"[\x80-\xff&](?:(?<=[\xc2-\xf4])[\x80-\xbf{_SPECIAL}]|(?<=[\x80-\x9f\xc0-\xff])[\x80-\x9f\xc0-\xff]{{2}}|(?<=[\x80-\x9f])|(?<=&)[#a-z])")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|quot|amp|lt|gt|apos|nbsp);")
_GB = re.compile("[\xa1-\xf7][\xa1-\xfe](?:[\xa1-\xf7][\xa1-\xfe])*")


class Repaired:
    """text, and end(i): the position in the stored text of the last character that became text[i]."""

    __slots__ = ("text", "_ends")

    def __init__(self, text: str):
        self.text, self._ends = text, None

    def end(self, i: int) -> int:
        return i if self._ends is None else int(self._ends[i])

    def ends(self, at: list[int]) -> list[int]:
        return at if self._ends is None else self._ends[at].tolist() if at else []

    def replace(self, seen: str, pattern: re.Pattern, change: Callable[[str], str | None], sizes: Callable[[list[str], list[str]], np.ndarray]) -> None:
        """Puts change(match) for each match of pattern in seen, which has the text's length; None leaves the match alone.

        sizes tells for all new characters of all matches how many old ones each takes up.
        """
        out, lengths, old, new, last = [], [], [], [], 0
        for m in pattern.finditer(seen):
            got = change(m[0])
            if not got:
                continue
            a, b = m.span()
            out += [self.text[last:a], got]
            lengths += [a - last, len(got)]
            old.append(m[0])
            new.append(got)
            last = b
        if not out:
            return
        out.append(self.text[last:])
        lengths.append(len(out[-1]))
        changed = np.repeat(np.arange(len(lengths)) % 2 == 1, lengths)
        size = np.ones(len(changed), np.int64)
        size[changed] = sizes(old, new)
        at = np.cumsum(size) - 1
        self._ends = at if self._ends is None else self._ends[at]
        self.text = "".join(out)


def _shares(old: list[str], new: list[str]) -> np.ndarray:
    """The old characters of each match dealt to its new ones in their order."""
    return np.concatenate([np.diff(np.arange(len(b) + 1) * len(a) // len(b)) for a, b in zip(old, new, strict=True)])


def _utf8(run: str) -> str | None:
    try:
        return run.encode("latin-1").decode()
    except UnicodeDecodeError:
        return None


def _utf8_sizes(old: list[str], _: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(old).encode("latin-1"), np.uint8)
    return np.diff(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)))


def _decoded(codec: str) -> Callable[[str], str]:
    return lambda run: run.encode("latin-1").decode(codec, "replace")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _count(codes: np.ndarray, first: str, last: str) -> int:
    """Characters from first to last."""
    return int(np.count_nonzero((codes >= ord(first)) & (codes <= ord(last))))


def _length(runs: list[str]) -> int:
    return sum(map(len, runs))


def repair(text: str) -> Repaired:
    """text with wrong decodings undone where nearly all of its odd characters agree with one; positions kept.

    UTF-8 read as windows-1252 or latin-1 (also twice), windows-1251 and GB 2312 read as latin-1, control characters
    that are windows-1252 punctuation, and HTML entities. Characters lost as '?' or U+FFFD stay as they are.
    """
    out = Repaired(text)
    if text.isascii() and "&" not in text:
        return out
    if not _SUSPECT.search(text):
        return out
    if "&" in text:
        out.replace(out.text, _ENTITY, html.unescape, _shares)
    for _ in range(2):
        seen = _SPECIALS.sub(lambda m: _TO_BYTE[m[0]], out.text)
        codes = _codes(seen)
        high = _count(codes, "\x80", "\xff")
        # at least every second character of a run continues one
        if not high or 2 * _count(codes, "\x80", "\xbf") < 0.9 * high:
            break
        runs = _UTF8_RUN.findall(seen)
        if _length(runs) < 0.9 * high:
            break
        read = {r: _utf8(r) for r in set(runs)}
        # a run that holds what is no character is taken character by character
        if all(read.values()):
            out.replace(seen, _UTF8_RUN, read.get, _utf8_sizes)
        else:
            out.replace(seen, _UTF8, _utf8, _utf8_sizes)
    t = out.text
    codes = _codes(t)
    narrow = _count(codes, "\xa0", "\xff")
    if narrow >= 6:
        if not any(c.isalpha() for c in set(t) if c >= "\u0250"):
            letters, low, paired = _count(codes, "A", "Z") + _count(codes, "a", "z"), _count(codes, "\xa1", "\xbf"), _length(_GB.findall(t))
            runs = re.findall("[\xc0-\xff][\xc0-\xff]{3}", t)
            if paired >= 0.9 * narrow and low > 0.12 * narrow and re.search("[\xa1-\xfe][\xa1-\xfe]{3}", t):
                out.replace(t, _GB, _decoded("gb18030"), _shares)
            elif len(runs) * 4 > 0.3 * narrow and narrow > 0.1 * letters:
                out.replace(t, _BYTES, _decoded("cp1251"), _shares)
    if _C1_SIGN.search(out.text):
        out.text = out.text.translate(_C1)
    return out
