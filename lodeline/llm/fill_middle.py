"""Fill-in-middle transformation.

A text is cut into units (runs of ASCII letters, and single other characters) at two
places that a hash of its id chooses, and given out as prefix, suffix and middle with
markers between.  The Split pre-tokenizer of the tokenizers library, with the letter
runs as isolated matches, supplies the code-point offsets; nothing is trained.  The
number of offsets is the number of units, and the offset of a rank is a cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters that are split at a time, or a whole run of letters if that is longer.
BLOCK = 1 << 16
LETTERS = "[A-Za-z]+"
_REST_OF_RUN = re.compile("[A-Za-z]*")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
_DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@cache
def _splitter():
    """The pre-tokenizer of this process."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(LETTERS), "isolated")


def _blocks(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a text with their offsets; no run of letters is in two."""
    start = 0
    while start < len(text):
        end = min(start + BLOCK, len(text))
        if text[end - 1].isascii() and text[end - 1].isalpha():
            end = _REST_OF_RUN.match(text, end).end()
        yield start, text[start:end]
        start = end


def unit_ends(text: str) -> np.ndarray:
    """Code-point offsets at which the units of a text end, in order, after a 0."""
    ends = [np.zeros(1, np.int64)]
    for start, piece in _blocks(text):
        split = _splitter().pre_tokenize_str(piece)
        at = np.fromiter((x for _, span in split for x in span), np.int64, 2 * len(split)).reshape(-1, 2)
        first = np.fromiter((s[0] for s, _ in split), "U1", len(split)).view(np.uint32) | 0x20
        letters = (first >= ord("a")) & (first <= ord("z"))
        # A run of letters is one unit; what lies between runs is a unit for each character.
        units = np.where(letters, 1, at[:, 1] - at[:, 0])
        rank = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        ends.append(start + np.repeat(np.where(letters, at[:, 1], at[:, 0] + 1), units) + rank)
    return np.concatenate(ends)


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2 ** 32 that seed and id choose."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def transformed(doc_id: int | None, text: str, ends: np.ndarray, seed: str = "1") -> tuple[str, str, int | None, int | None]:
    """form, output, and the characters of prefix and middle."""
    h = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= RATE:
        return "plain", text, None, None
    a, b = (int(ends[k]) for k in sorted((h[0] % len(ends), h[1] % len(ends))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SUFFIX_FIRST:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def restored(form: str, output: str) -> str:
    """The text, from the output and its form alone.  No marker occurs in a part, nor can
    the end of one and a marker together make another, so the first found is the right one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return one + middle + other if form == "psm" else other + middle + one


def _rows(seed: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                ends = unit_ends(text)
                form, output, prefix, middle = transformed(doc_id, text, ends, seed)
                back = restored(form, output)
                row = (doc_id, len(ends) - 1, form, prefix, middle, *((sha(output), sha(back)) if digest else (output, back)))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in (_DIGEST if digest else _SCHEMA).split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1", digest: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n, form, prefix_chars, middle_chars, output,
    restored; with digest the sha256 of the two texts in their place.

    Rows are transformed each by itself, without a shuffle.

    Edges: a null text is an empty one, which has no units and stays plain, as does
    one that holds a marker; a null id is hashed as an empty string; rows with equal
    ids are cut at the same ranks, and repeated rows give repeated rows; long texts
    are split in blocks; an empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    return docs.select("doc_id", "text").mapInArrow(_rows(seed, digest), _DIGEST if digest else _SCHEMA)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), digest=True)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS hs FROM d),
c AS (SELECT *, len(units) AS n, least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS a, greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
