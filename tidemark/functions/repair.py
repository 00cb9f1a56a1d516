"""Repair of broken JSON objects (section 2.10): a pushdown parser that reads on whatever comes."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deeper nesting is no object that anything else could read.
DEEPEST = 500

_QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’"}
_SKIP = re.compile(r"(?:\s++|//[^\n]*+|#[^\n]*+|/\*(?s:.*?)(?:\*/|\Z))++")
_BARE = re.compile(r"(?:(?!//|/\*)[^,:{}\[\]\"\n\r])++|/")
_BARE_VALUE = re.compile(r"(?:(?!\s//|/\*|\s#)[^,{}\[\]\n\r])++|/")
_NUMBER = re.compile(r"[+-]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?")
_HEX = re.compile(r"[+-]?0[xX][0-9a-fA-F]+")
_WORDS = {"true": True, "false": False, "null": None, "none": None, "nil": None, "undefined": None, "nan": None, "infinity": None, "-infinity": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\", "/": "/", "\n": ""}


def bare(word: str) -> Any:
    """What a word without quotes means: a literal, a number, else itself as a string."""
    word = word.strip()
    if word.lower() in _WORDS:
        return _WORDS[word.lower()]
    if _HEX.fullmatch(word):
        return int(word, 16)
    if _NUMBER.fullmatch(word):
        plain = word.replace("_", "")
        if len(plain) > 400:
            return word
        number = float(plain) if re.search(r"[.eE]", plain) else int(plain)
        return number if abs(number) != float("inf") else None
    return word


class _Text:
    """The text and the place that has been read up to."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        """The next character that is no space or comment; '' at the end."""
        if m := _SKIP.match(self.text, self.at):
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def quoted(self, key: bool) -> str:
        """A string.  A quote ends it if something that may follow a string does, or nothing; else it is one of its characters.

        What is never closed goes on to the end of the text, a key to the colon.
        """
        text, close = self.text, _QUOTES[self.text[self.at]]
        out, k = [], self.at + 1
        stop = re.compile(rf"[{re.escape(close)}\\]")
        while m := stop.search(text, k):
            out.append(text[k : m.start()])
            k = m.end()
            if m[0] == "\\":
                nxt = text[k : k + 1]
                if nxt == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[k + 1 : k + 5]):
                    out.append(chr(int(text[k + 1 : k + 5], 16)))
                    k += 5
                else:
                    out.append(_ESCAPES.get(nxt, nxt))
                    k += 1
                continue
            after = _SKIP.match(text, k)
            end = after.end() if after else k
            follows = text[end : end + 1]
            if follows in ("", ",", "}", "]", ":") or (end > k or follows in "\"{[" if key else self._begins_key(end)):
                self.at = k
                return "".join(out)
            out.append(m[0])
        if key and (colon := text.find(":", self.at + 1)) >= 0:
            word = text[self.at + 1 : colon].strip()
            self.at = colon
            return word
        out.append(text[k:])
        self.at = len(text)
        return "".join(out).rstrip().rstrip("}]").rstrip() if not key else "".join(out)

    def _begins_key(self, at: int) -> bool:
        """Whether a quoted word and a colon come next: the comma before them is missing."""
        return re.compile(r"[\"'][^\"'\n]{0,200}[\"']\s{0,20}:").match(self.text, at) is not None


def repaired(text: str | None) -> Any:
    """The first object in a text, whatever is broken in it; None where no brace opens.

    Read as they are meant: prose and fences around the object, comments,
    single, curly or missing quotes, quotes within strings, raw line ends,
    missing or doubled commas, missing colons and values (null), Python's
    literals, numbers as ``.5``, ``+1``, ``0x1f`` or ``1_000``.  NaN and
    infinities are null.  What is open at the end of the text is closed; a
    closing bracket that nothing opened is left out, one of another kind closes
    what is open within.  Of equal keys the last counts.  Nesting deeper than
    DEEPEST gives None.
    """
    if not text or (start := text.find("{")) < 0:
        return None
    source = _Text(text)
    source.at = start + 1
    top: dict[str, Any] = {}
    stack: list[Any] = [top]
    keys: list[str | None] = [None]  # of each open object, the key that waits for its value

    def place(value: Any) -> None:
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value
            keys[-1] = None

    def close(kind: type) -> bool:
        """Close up to the innermost open bracket of a kind; whether the whole object is closed."""
        if not any(isinstance(x, kind) for x in stack):
            return False
        while True:
            done = stack.pop()
            if isinstance(done, dict) and keys[-1] is not None:
                done[keys[-1]] = None
            keys.pop()
            if isinstance(done, kind):
                return not stack

    while (c := source.skip()) and len(stack) <= DEEPEST:
        in_object = isinstance(stack[-1], dict)
        if c in "}]":
            source.at += 1
            if close(dict if c == "}" else list):
                return top
        elif c == ",":
            source.at += 1
            if in_object and keys[-1] is not None:
                place(None)
        elif c == ":":
            source.at += 1
        elif in_object and keys[-1] is None:
            if c in "{[":  # a value without a key
                source.at += 1
                keys[-1] = ""
                new: Any = {} if c == "{" else []
                place(new)
                stack.append(new)
                keys.append(None)
            elif c in _QUOTES:
                keys[-1] = source.quoted(key=True)
            else:
                m = _BARE.match(source.text, source.at)
                keys[-1] = m[0].strip()
                source.at = m.end()
        elif c in "{[":
            source.at += 1
            new = {} if c == "{" else []
            place(new)
            stack.append(new)
            keys.append(None)
        elif c in _QUOTES:
            place(source.quoted(key=False))
        else:
            m = _BARE_VALUE.match(source.text, source.at)
            place(bare(m[0]))
            source.at = m.end()
    if len(stack) > DEEPEST:
        return None
    for open_, key in zip(stack, keys, strict=True):
        if isinstance(open_, dict) and key is not None:
            open_.setdefault(key, None)
    return top


def json_text(text: str | None) -> str | None:
    """``repaired`` as JSON."""
    found = repaired(text)
    return None if found is None else json.dumps(found, ensure_ascii=False).encode("utf-8", "replace").decode()


def _json_texts(texts: pd.Series) -> pd.Series:
    return pd.Series([json_text(t) if isinstance(t, str) else None for t in texts], dtype=object)


def repair(text: Column) -> Column:
    """The repaired object of a text as JSON."""
    return F.pandas_udf(_json_texts, "string")(text)
