"""Inline markup of a paragraph as text and emphasis ranges. Tags nest freely and may be left open, which no pattern of SQL
pairs, so a small parser reads each fragment in Arrow batches; white space is then collapsed by `functions.offsets`."""

from __future__ import annotations

import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offsets import collapse_ranges

#: The entities by name that are decoded; others stay as they are.
ENTITIES = (
    "nbsp amp lt gt quot apos laquo raquo mdash ndash hellip deg sect prime Prime copy reg rsquo lsquo ldquo rdquo shy middot bull times "
    "frac12 frac14 frac34 euml eacute egrave ecirc agrave ccedil ouml uuml auml szlig"
).split()
#: Tags that stand for a space, and the kinds of emphasis.
BREAKS = ["br", "p", "div", "dd", "li"]
EMPHASIS = {"i": "em", "em": "em", "b": "strong", "strong": "strong"}
TAG = r"</?[a-zA-Z][a-zA-Z0-9]*\b[^>]*>"
ENTITY = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z0-9]+);"
#: Every fragment is the concatenation of its pieces: tags, entities, other text.
PIECE = rf"{TAG}|{ENTITY}|[^<&]+|[<&]"
FRAGMENT = "struct<text:string,ranges:array<struct<start:int,end:int,kind:string>>>"


def decoded(entity: str) -> str:
    """The character of one reference; what is no known name and no code point stays."""
    name = entity[1:-1]
    if name[0] != "#":
        return html5[name + ";"] if name in ENTITIES else entity
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else entity


def read_fragment(markup: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and (start, end, kind) in it. Superscripts are note marks and go with all they hold; emphasis that stays open ends
    with the fragment."""
    said, size, hidden, ranges = [], 0, 0, []
    open_: dict[str, list[int]] = {"em": [], "strong": []}
    for piece in re.findall(PIECE, markup):
        is_tag = piece[0] == "<" and len(piece) > 1
        name = re.match("[a-z0-9]+", piece.lstrip("</").lower())[0] if is_tag else ""
        ends = piece.startswith("</")
        if name == "sup":
            hidden = max(0, hidden + (-1 if ends else 1))
        elif hidden:
            continue
        elif name in EMPHASIS:
            starts = open_[EMPHASIS[name]]
            if not ends:
                starts.append(size)
            elif starts:
                ranges.append((starts.pop(), size, EMPHASIS[name]))
        else:
            out = " " if name in BREAKS else "" if is_tag else decoded(piece) if piece[0] == "&" and len(piece) > 1 else piece
            said.append(out)
            size += len(out)
    ranges += [(s, size, kind) for kind, starts in open_.items() for s in starts]
    return "".join(said), sorted(r for r in ranges if r[1] > r[0])


def _read(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_fragment(m or "") for m in markup], columns=["text", "ranges"])


def fragments(df: DataFrame, keys: list[str], markup: Column) -> DataFrame:
    """keys, text and ranges of each fragment, white space collapsed. A null fragment reads as an empty one."""
    read = df.select(*keys, F.pandas_udf(_read, FRAGMENT)(markup).alias("r"))
    return read.select(*keys, collapse_ranges(F.col("r.text"), F.col("r.ranges")).alias("c")).select(*keys, "c.text", "c.ranges")
