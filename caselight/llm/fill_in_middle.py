"""Fill-in-the-middle: texts cut at token boundaries and put in another order, found through sparse checkpoints.

A unit is a word with the white space before it; white space at the end of a text is a unit of its
own. Counting the units walks over a text once and records the byte and code-point offset of every
STEP-th boundary. A cut then takes a binary search among the checkpoints and a rescan of fewer
than STEP units, whatever the length of the text, and no list of units is ever held.

Defined cases: a null or empty text has no units and stays plain, like one that contains a sign of
the form; a null doc_id is drawn for as an empty number; repeated rows get the same cuts; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts

#: Units between two checkpoints.
STEP = 64
#: Signs before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are transformed, and how many of those put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42

_WORD_UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_STEP_UNITS = re.compile(f"(?:{_WORD_UNIT}){{{STEP}}}")
_ONE_UNIT = re.compile(_WORD_UNIT)
_REST = re.compile(f"(?:{_WORD_UNIT})*+")


class Checkpoints:
    """The number of units of a text, and offsets of every STEP-th boundary between them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.chars, self.bytes = [0], [0]
        at = 0
        while step := _STEP_UNITS.match(text, at):
            self.bytes.append(self.bytes[-1] + len(text[at : step.end()].encode("utf-8", "surrogatepass")))
            at = step.end()
            self.chars.append(at)
        words = sum(1 for _ in _ONE_UNIT.finditer(text, at, _REST.match(text, at).end()))
        self.units = (len(self.chars) - 1) * STEP + words
        #: White space at the end is a unit.
        self.tail = bool(text) and text[-1] in " \t\n\v\f\r"
        self.units += self.tail

    def _walk(self, k: int, n: int) -> tuple[int, int]:
        """Offsets of the boundary n units behind checkpoint k."""
        at = start = self.chars[k]
        for _ in range(n):
            unit = _ONE_UNIT.match(self.text, at)
            at = unit.end() if unit else len(self.text)
        return at, self.bytes[k] + len(self.text[start:at].encode("utf-8", "surrogatepass"))

    def after_units(self, n: int) -> tuple[int, int]:
        """Code points and bytes before the boundary that n units end at."""
        k = bisect_right(range(0, len(self.chars) * STEP, STEP), n) - 1
        return self._walk(k, n - k * STEP)

    def units_before(self, char: int) -> int:
        """How many whole units end at or before a code-point offset."""
        k = bisect_right(self.chars, char) - 1
        found, at = k * STEP, self.chars[k]
        while (unit := _ONE_UNIT.match(self.text, at)) and unit.end() <= char:
            found, at = found + 1, unit.end()
        return found + (self.tail and char >= len(self.text))


def _draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _plan(doc_id: int | None, text: str, rate: int, suffix_first: int, seed: int) -> tuple:
    """n, form, then code points and bytes of prefix and middle."""
    points = Checkpoints(text)
    n = points.units
    one, two, drawn, order = _draws(doc_id, seed)
    if not text or drawn % 100 >= rate or any(sign in text for sign in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None
    a, b = sorted((one % (n + 1), two % (n + 1)))
    (a_char, a_byte), (b_char, b_byte) = points.after_units(a), points.after_units(b)
    return n, "spm" if order % 100 < suffix_first else "psm", a_char, b_char - a_char, a_byte, b_byte - a_byte


CUTS = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long"


def cuts(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """The columns CUTS: where each text is to be cut, in code points and in bytes, and into which form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].astype(object)]
            rows = [_plan(i, text, rate, suffix_first, seed) for i, text in zip(ids, batch["text"], strict=True)]
            found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"])
            for c in found.columns.drop("form"):
                found[c] = found[c].astype("Int64")
            yield pd.concat([pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": batch["text"].to_numpy()}), found], axis=1)

    return doc_texts(docs).mapInPandas(run, CUTS)


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars and output: the text in its new order."""
    found = cuts(docs, rate, suffix_first, seed)
    start = F.col("prefix_chars").cast("int")
    width = F.col("middle_chars").cast("int")
    prefix = F.substring("text", F.lit(1), start)
    middle = F.substring("text", start + 1, width)
    suffix = F.substring("text", start + width + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form came from; no part contains a sign, so the first of each is its place."""
    sign = len(MIDDLE)
    begin = F.lit(sign + 1)
    at = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    end = F.locate(MIDDLE, output)
    one = F.substring(output, begin, at - begin)
    two = F.substring(output, at + sign, end - at - sign)
    three = F.substring(output, end + sign, F.length(output))
    back = F.when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
    return F.when(form == "plain", output).otherwise(back)


def cut_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM texts),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
