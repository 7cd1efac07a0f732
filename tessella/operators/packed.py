"""Several values packed in one field: one row per value, in the written order (problem 3).

Numbers are parsed by built-in expressions. For names the method is
dictionary-guided: whole values that hold a delimiter are gathered from the
column itself, a multi-pattern automaton finds them in each cell, and dynamic
programming picks the cover of fewest values, so that a delimiter inside a
legitimate value doesn't split it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.runtime import cut, spread

_WIDE = "０１２３４５６７８９／，；－．～｜［］＂　"
_NARROW = "0123456789/,;-.~|[]\" "
# What stands between the ends of a range.
RANGE_WORDS = r"(?:-|‐|‑|–|—|~|〜|～|至|到|\bto\b|\bthrough\b)"
# Cells that say "none".
PLACEHOLDERS = ("", "-", "--", "—", "/", "#", "*", "n/a", "none", "null", "未披露", "未公开", "未知", "无", "暂无", "不详")
# Legal forms, in lower case without dots and blanks.
LEGAL_FORMS = frozenset(
    "inc incorporated corp corporation co company ltd limited llc llp lp lllp plc pllc pc gmbh mbh ggmbh ag kg kgaa ohg ug se sa sas sarl srl spa sl slu bv nv as a/s aps ab oy oyj asa oü sro zrt kft pty pte bhd sdnbhd kk pllp coltd coinc cokg gmbh&cokg".split()
)
#: Characters that may separate names; a blank-bounded "and" does too.
_DELIMITERS = ";；|、,，/\n\r"
_AND = re.compile(r"\s(?:and|und|et)\s")
#: Cells that a worker remembers; the table is emptied when full.
REMEMBERED = 100_000
#: Characters of dictionary entries in one automaton: only the memory of a worker hangs on it, no result.
BLOCK_CHARS = 2_000_000
#: The greatest number that can be a claim's (an INT), and values of a cell that are made in one row.
MOST_NUMBER, RANGE_PIECE = 2_147_483_647, 10_000


def number_ranges(cell: Column) -> Column:
    """The claim numbers of a cell as an array of ``(lo, hi)`` structs of BIGINT, in the written order; lo over hi counts downwards.

    Any delimiter will do. Zero is no claim number (so "3.0" is the one value
    3), nor is a number beyond ``MOST_NUMBER``: with it, a whole range is
    unreadable and none of its numbers comes out. Null for a null cell.
    """
    text = F.translate(F.lower(cell), _WIDE, _NARROW)
    found = F.regexp_extract_all(text, F.lit(rf"(\d+(?:\s*{RANGE_WORDS}\s*\d+)?)"), F.lit(1))
    first = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("bigint")
    last = lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("bigint")
    spans = F.transform(found, lambda x: F.struct(first(x).alias("lo"), last(x).alias("hi")))
    sound = F.filter(spans, lambda x: F.coalesce(F.greatest(x["lo"], x["hi"]).between(1, MOST_NUMBER) & x["lo"].isNotNull() & x["hi"].isNotNull(), F.lit(False)))
    return F.transform(sound, lambda x: F.struct(F.greatest(x["lo"], F.lit(1)).alias("lo"), F.greatest(x["hi"], F.lit(1)).alias("hi")))


def first_number(cell: Column) -> Column:
    """The first claim number of a cell; null without one. Ranges aren't expanded for it."""
    return F.get(number_ranges(cell), F.lit(0))["lo"]


def _size(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, x: n + F.abs(x["hi"] - x["lo"]) + 1)


def number_values(cell: Column) -> Column:
    """The claim numbers of a cell as an array of BIGINT, ranges expanded, in the written order (see ``number_ranges``).

    Meant for cells of few values: ``split_numbers`` takes ranges of any length.
    """
    return F.flatten(F.transform(number_ranges(cell), lambda x: F.sequence(x["lo"], x["hi"])))


def split_numbers(df: DataFrame, key: str, cell: str) -> DataFrame:
    """``(row_id, pos, val, n)``: one row per number of a cell; n is the number of values of the cell. Rows with a null key fall out.

    Cells of more than ``RANGE_PIECE`` values are dealt out in pieces of their
    ranges, so that neither a row nor a task holds a long range.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("row_id"), number_ranges(F.col(cell)).alias("ranges")).withColumn("n", _size(F.col("ranges")))
    few = rows.where(F.col("n") <= RANGE_PIECE).select("row_id", F.posexplode(F.flatten(F.transform("ranges", lambda x: F.sequence(x["lo"], x["hi"])))).alias("p", "v"), "n")
    few = few.select("row_id", (F.col("p") + 1).cast("bigint").alias("pos"), "v", "n")
    # A long cell: each range with the number of values before it, cut into pieces, each piece by itself.
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint,before:bigint>>")
    begun = F.aggregate("ranges", empty, lambda done, x: F.concat(done, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.coalesce(_after(F.try_element_at(done, F.lit(-1))), F.lit(0).cast("bigint")).alias("before")))))
    long = rows.where(F.col("n") > RANGE_PIECE).select("row_id", "n", F.explode(begun).alias("r")).select("row_id", "n", "r.*")
    pieces = long.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.abs(F.col("hi") - F.col("lo")), F.lit(RANGE_PIECE).cast("bigint"))).alias("at")).repartition("row_id", "lo", "at")
    last = F.least(F.col("at") + RANGE_PIECE - 1, F.abs(F.col("hi") - F.col("lo")))
    many = pieces.select("*", F.explode(F.sequence("at", last)).alias("i")).select("row_id", (F.col("before") + F.col("i") + 1).alias("pos"), (F.col("lo") + F.signum(F.col("hi") - F.col("lo")).cast("bigint") * F.col("i")).alias("v"), "n")
    return few.unionByName(many).select("row_id", F.col("pos"), F.col("v").cast("string").alias("val"), "n")


def _after(r: Column) -> Column:
    return r["before"] + F.abs(r["hi"] - r["lo"]) + 1


# ------------------------------------------------------------------ names


def _legal(text: str) -> bool:
    return re.sub(r"[.\s]", "", text.casefold()) in LEGAL_FORMS


def _pieces(cell: str) -> list[tuple[str, str, bool]]:
    """The cell cut at every delimiter outside quotes: (written piece, delimiter after it, whether it was quoted)."""
    out, i, n, start = [], 0, len(cell), 0
    while i <= n:
        head = cell[start:i]
        if i < n and cell[i] in "\"'“‘" and not head.strip():
            close = {"“": "”", "‘": "’"}.get(cell[i], cell[i])
            j = i + 1
            while j < n:
                if cell[j] == close:
                    if j + 1 < n and cell[j + 1] == close:
                        j += 2
                        continue
                    rest = cell[j + 1 :]
                    after = rest.lstrip(" \t 　")
                    if not after or after[0] in _DELIMITERS or _AND.match(rest):
                        break
                j += 1
            if j < n:
                end = j + 1
                while end < n and cell[end] in " \t 　" and not _AND.match(cell, end):
                    end += 1
                m = _AND.match(cell, end) or (_AND.match(cell, j + 1))
                delimiter = cell[end] if end < n and cell[end] in _DELIMITERS else m.group() if m else ""
                out.append((cell[i + 1 : j].replace(close * 2, close), delimiter, True))
                start = i = (end + 1 if delimiter and not m else m.end() if m else n + 1)
                if i > n or not delimiter:
                    return out
                continue
        if i == n:
            out.append((cell[start:], "", False))
            break
        if cell[i] in _DELIMITERS:
            out.append((cell[start:i], cell[i], False))
            start = i = i + 1
            continue
        if cell[i].isspace() and (m := _AND.match(cell, i)):
            out.append((cell[start:i], m.group(), False))
            start = i = m.end()
            continue
        i += 1
    return out


def _join_forms(pieces: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """Puts a legal form back that a comma or a slash cut off ("Inc." after a comma, "A/S")."""
    out: list[tuple[str, str, bool]] = []
    for text, delimiter, quoted in pieces:
        if out and not quoted and not out[-1][2] and out[-1][0].strip():
            before, cut_by, _ = out[-1]
            if cut_by in ",，" and _legal(text):
                out[-1] = (before + cut_by + text, delimiter, False)
                continue
            if cut_by == "/" and (m := re.search(r"(?:^|\s)(\S+)$", before)) and (t := re.match(r"(\S+)\s*$", text)) and _legal(f"{m.group(1)}/{t.group(1)}"):
                out[-1] = (before + cut_by + text, delimiter, False)
                continue
        out.append((text, delimiter, quoted))
    return out


def _clean(text: str) -> str:
    return text.strip(" \t\r\n 　")


def whole_values(cell: str | None) -> list[str]:
    """The values of a cell that hold a delimiter inside and stand there unmistakably: quoted, or with a legal form cut off by one."""
    if not cell:
        return []
    out = []
    for text, _, quoted in _join_forms(_pieces(cell)):
        text = _clean(text)
        if text and (any(x in text for x in ",，/、;；|") or _AND.search(text)):
            out.append(text)
    return out


def known_spans(pieces: list[tuple[str, str, bool]], known: ahocorasick.Automaton | None) -> set[tuple[int, int]]:
    """(first, last piece) of the known whole values of several pieces that a cell holds."""
    if known is None or len(pieces) < 2:
        return set()
    # The pieces are laid out again with their delimiters; a known value must begin and end with a piece.
    line, begin, end = "", {}, {}
    for i, (text, delimiter, quoted) in enumerate(pieces):
        if quoted:
            line += "\0"
        lead = len(text) - len(text.lstrip())
        begin[len(line) + lead] = i
        end[len(line) + len(text.rstrip())] = i
        line += text + ("\0" if quoted else "") + delimiter
    out = set()
    for last, length in known.iter(line):
        a, b = begin.get(last + 1 - length), end.get(last + 1)
        if a is not None and b is not None and b > a:
            out.add((a, b))
    return out


def best_cover(pieces: list[tuple[str, str, bool]], known: set[tuple[int, int]]) -> list[str]:
    """The values of the cover of fewest values, among those of the one with most known values."""
    n = len(pieces)
    spans: dict[int, list[int]] = {}
    for a, b in known:
        spans.setdefault(a, []).append(b)
    best: list[tuple[int, int, int]] = [(0, 0, n)] * (n + 1)
    for i in range(n - 1, -1, -1):
        blank = not _clean(pieces[i][0])
        choice = (best[i + 1][0] + (not blank), best[i + 1][1], i + 1)
        for b in spans.get(i, ()):
            choice = min(choice, (best[b + 1][0] + 1, best[b + 1][1] - 1, b + 1))
        best[i] = choice
    out, i = [], 0
    while i < n:
        j = best[i][2]
        value = _clean("".join(text + (delimiter if x + 1 < j else "") for x, (text, delimiter, _) in enumerate(pieces[i:j], i)))
        if value:
            out.append(value)
        i = j
    return out


def _cell_pieces(cell: str | None) -> list[tuple[str, str, bool]]:
    return [] if cell is None or _clean(cell).casefold() in PLACEHOLDERS else _join_forms(_pieces(cell))


def segment(cell: str | None, known: ahocorasick.Automaton | None = None) -> list[str]:
    """The values of a cell in the written order; null, empty and placeholder cells have none.

    Pieces between delimiters are covered by values; a known whole value may
    cover several pieces. Of all covers the one of fewest values counts, among
    those the one with most known values.
    """
    pieces = _cell_pieces(cell)
    return best_cover(pieces, known_spans(pieces, known))


def _automaton(words: list[str]) -> ahocorasick.Automaton | None:
    if not words:
        return None
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _blocks(rows: Iterator, limit: int) -> Iterator[list[str]]:
    block, size = [], 0
    for row in rows:
        block.append(row[0])
        size += len(row[0])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def split_names(df: DataFrame, key: str, cell: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(row_id, pos, val, n)``: one row per name of a cell; n is the number of values of the cell.

    Names lose outer blanks and enclosing quotes; quotes doubled inside become
    single. Null, empty and placeholder cells give no row; rows with a null key
    fall out. Nothing but the dictionary is shuffled: workers remember cells, so
    a hot cell costs a lookup. The dictionary (distinct whole values with a
    delimiter inside) is a written table that is met in blocks of
    ``block_chars`` characters; the driver and a worker hold one block at a
    time. All blocks' hits are gathered before each cell's one best cover is
    sought, so the blocks' size has no effect on the result.
    """
    kind = df.schema[key].dataType.simpleString()
    bare = F.lower(F.regexp_replace(cell, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", ""))
    rows = spread(df.where(F.col(key).isNotNull() & F.col(cell).isNotNull() & ~bare.isin(*PLACEHOLDERS)).select(F.col(key).alias("row_id"), F.col(cell).alias("cell")))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"w": sorted({w for c in set(batch["cell"]) for w in whole_values(c)})}, dtype=object)

    words = cut(rows.where(F.col("cell").rlike(r"[\"'“‘,，/]")).mapInPandas(gather, "w string").distinct())

    def meet(out: DataFrame, block: list[str], last: bool) -> DataFrame:
        """``out`` with the block's hits added to ``hits`` (pairs of pieces, flat), or after the last block with the values."""
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _automaton(shared.value)
            seen: dict[str, list] = {}
            for batch in batches:
                values = []
                for c, before in zip(batch["cell"], batch["hits"]):
                    if c not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        pieces = _cell_pieces(c)
                        spans = known_spans(pieces, known)
                        if before is not None:
                            spans |= set(zip(before[::2].tolist(), before[1::2].tolist()))
                        seen[c] = best_cover(pieces, spans) if last else [x for span in sorted(spans) for x in span]
                    values.append(seen[c])
                if last:
                    yield pd.DataFrame({"row_id": batch["row_id"], "vals": pd.Series(values, dtype=object)})
                else:
                    yield pd.DataFrame({"row_id": batch["row_id"], "cell": batch["cell"], "hits": pd.Series(values, dtype=object)})

        return out.mapInPandas(run, f"row_id {kind}, vals array<string>" if last else f"row_id {kind}, cell string, hits array<int>")

    out, blocks = rows.withColumn("hits", F.lit(None).cast("array<int>")), _blocks(words.toLocalIterator(), block_chars)
    block = next(blocks, [])
    for ahead in blocks:
        out, block = cut(meet(out, block, False)), ahead
    out = meet(out, block, True)
    exploded = out.select("row_id", F.posexplode("vals").alias("p", "val"), F.size("vals").alias("n"))
    return exploded.select("row_id", (F.col("p") + 1).alias("pos"), "val", "n")


def packed_values(claims: DataFrame, news: DataFrame) -> DataFrame:
    """``(field, row_id, pos, val)`` of the cells with two or more values of both columns."""
    numbers = split_numbers(claims, "claim_id", "claim_ref_pre").where("n > 1").select(F.lit("claim_ref_pre").alias("field"), "row_id", F.col("pos").cast("int").alias("pos"), "val")
    names = split_names(news, "news_id", "invester").where("n > 1").select(F.lit("invester").alias("field"), "row_id", "pos", "val")
    return numbers.unionByName(names)
