"""Token counts of sections, from one encoding of the whole document.

Encoding each section by itself would count other tokens than the document
has: merges cross section borders. Here the whole text is encoded once. The
byte-level vocabulary is lossless, so the lengths of the tokens' bytes give
each token's span, and one sorted search joins the spans to the sections. A
token that crosses a border goes where an explicit rule says:

- ``first``: to the section of its first byte,
- ``last``: to the section of its last byte,
- ``most``: to the section with most of its bytes, the earlier one on a tie.

The sections' counts always add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import narrow


#: White space as the patterns' \\s has it: runs longer than the pattern's machine can go back over.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


class SpanEncoder:
    """Token spans in bytes by a rank file of the tiktoken library."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.looks_ahead = r"\s+(?!\S)" in pattern
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End of each token's bytes in the UTF-8 text."""
        return np.cumsum(self.length[np.array(self.ids(text), np.int64)])

    def ids(self, text: str) -> list[int]:
        """The text's tokens.

        The pattern takes a run of white space as one piece, but for its last
        character if a word follows, and fails on a run of hundreds of thousands.
        So a long run is parted from the text there and merged as that piece.
        """
        out, at = [], 0
        for run in _RUN.finditer(text) if self.looks_ahead else ():
            cut = run.end() - (run.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : cut])
            at = cut
        return out + self.encoding.encode_ordinary(text[at:])


def lines(text: str) -> list[int]:
    """Ends, in characters, of a text's lines, each with its line break; the first is the title."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many of those cross a border; sections are back to back."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crosses = first != last
    to = first if rule == "first" else last
    if rule == "most":
        to = first.copy()
        for i in np.flatnonzero(crosses).tolist():
            edges = np.concatenate(([starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]))
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(section_ends)
    return np.bincount(to, minlength=n), np.bincount(to[crosses], minlength=n)


_ENCODERS: dict[tuple[str, str], SpanEncoder] = {}


def encoder(path: str, pattern: str) -> SpanEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = SpanEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def section_tokens(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[int]] = lines, rule: str = "first") -> DataFrame:
    """``doc_id, section, char_start, char_end, n_tokens, n_crossing``, a row a section.

    ``sections`` gives the ends of back-to-back sections in characters, the last
    being the text's length. A null or empty text is one empty section without
    tokens. Repeated rows give repeated sections; null ids stay null. A text of
    any length, or with any run of white space, is encoded whole.
    """
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    d = narrow(docs, doc_id=F.col(id_col).cast("bigint"), text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                ends = sections(text) if text else [0]
                starts = [0, *ends[:-1]]
                if text.isascii():
                    in_bytes = np.array(ends, np.int64)
                else:
                    in_bytes = np.cumsum([len(text[a:b].encode()) for a, b in zip(starts, ends)])
                n, crossing = attribute(enc.ends(text), in_bytes, rule) if text else (np.zeros(1, int), np.zeros(1, int))
                for column, values in zip(out, ([doc_id.as_py()] * len(ends), range(len(ends)), starts, ends, n.tolist(), crossing.tolist())):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return d.mapInArrow(run, "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long")


def field_tokens(records: DataFrame, fields: list[str], tokenizer: str, pattern: str, id_col: str, separator: str = "\n", rule: str = "first") -> DataFrame:
    """``id, field, n_tokens`` for a record whose fields are encoded as one text.

    Fields are joined by ``separator``, which counts with the field before it. A
    null field is empty.
    """
    parts = [F.concat(F.coalesce(records[f].cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    d = records.select(records[id_col].alias("id"), F.array(*parts).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pattern)
        for batch in batches:
            rows, names, counts = [], [], []
            for i, p in enumerate(batch.column(1).to_pylist()):
                n, _ = attribute(enc.ends("".join(p)), np.cumsum([len(x.encode()) for x in p]), rule)
                rows += [i] * len(p)
                names += fields
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["id", "field", "n_tokens"])

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, field string, n_tokens long")
