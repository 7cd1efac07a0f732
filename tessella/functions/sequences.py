"""Biological sequences as read from patents: cleaning, records, notation, motifs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Amino acids, three letters to one.
AMINO = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Asx": "B", "Glx": "Z", "Xaa": "X"}
#: Share of residue letters from which a line counts as of a type.
LEAST_SHARE = 0.7


def fix_brackets(line: Column) -> Column:
    """Numeric headers with their brackets: ``<210》``, ``210>``, ``(210>`` and ``<210`` become ``<210>``."""
    out = F.translate(line, "《》〈〉", "<><>")
    out = F.regexp_replace(out, r"^\s*[(\[{]?(\d{3})>", "<$1>")
    return F.regexp_replace(out, r"<(\d{3})(?!>)[)\]}]?", "<$1>")


def clean_line(line: Column) -> Column:
    """A sequence line: brackets fixed, half width, East Asian characters out."""
    from tessella.functions.text import full_to_half

    return F.trim(F.regexp_replace(full_to_half(fix_brackets(line)), r"[぀-ヿ㐀-鿿]", ""))


def residue_share(line: Column, kind: str) -> Column:
    """The share of characters that are bases (DNA) or belong to three-letter amino acids (PRT)."""
    plain = F.regexp_replace(line, r"[\s\d]", "")
    hits = F.regexp_count(plain, F.lit(r"(?i)[acgtunw]")) if kind == "DNA" else 3 * F.regexp_count(plain, F.lit("(?i)" + "|".join(AMINO)))
    return F.when(F.length(plain) > 0, hits / F.length(plain)).otherwise(F.lit(0.0))


def line_type(line: Column) -> Column:
    """``header`` for a numeric header, ``PRT`` or ``DNA`` by residue share (protein first), else ``other``."""
    return F.when(F.regexp_like(line, F.lit(r"^<\d{3}>")), "header").when(residue_share(line, "PRT") > LEAST_SHARE, "PRT").when(residue_share(line, "DNA") > LEAST_SHARE, "DNA").otherwise("other")


def merge_lines(lines: DataFrame, key: str = "patent_id", number: str = "line_no", line: str = "line") -> DataFrame:
    """``(key, seq_no, kind, info, sequence)``: one row per ``<400>`` record.

    Lines up to the next numeric header belong to the record; ``kind`` is that
    of most of its lines. Records without a sequence line fall out.
    """
    clean = lines.where(F.col(line).isNotNull()).withColumn("c", clean_line(F.col(line))).withColumn("t", line_type(F.col("c")))
    w = Window.partitionBy(key).orderBy(number)
    headed = clean.withColumn("h", F.sum((F.col("t") == "header").cast("int")).over(w)).withColumn("is400", F.startswith("c", F.lit("<400>")))
    info = headed.where("is400").select(key, "h", F.col("c").alias("info"))
    body = headed.where("t in ('PRT', 'DNA')").join(info, [key, "h"])
    packed = F.sort_array(F.collect_list(F.struct(number, "c")))
    out = body.groupBy(key, "h", "info").agg(F.when(F.count_if(F.col("t") == "PRT") >= F.count_if(F.col("t") == "DNA"), "PRT").otherwise("DNA").alias("kind"), F.array_join(F.transform(packed, lambda x: x["c"]), "").alias("sequence"))
    return out.withColumn("seq_no", F.row_number().over(Window.partitionBy(key).orderBy("h"))).select(key, "seq_no", "kind", "info", "sequence")


def one_letter(sequence: Column) -> Column:
    """Three-letter amino acids as one letter each; what is left in small letters becomes X, one per three; the rest is dropped: ``ArgMetddPhe`` → ``RMXF``."""
    out = sequence
    for three, one in AMINO.items():
        out = F.replace(out, F.lit(three), F.lit(one))
    for n in range(4, 0, -1):
        out = F.regexp_replace(out, rf"(?<![a-z])[a-z]{{{3 * n - 2},{3 * n}}}(?![a-z])", "X" * n)
    return F.regexp_replace(out, "[^A-Z]", "")


def repair_amino(text: Column) -> Column:
    """Tokens of a protein in the right case, each that is one edit from exactly one amino acid repaired, single letters dropped."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: F.length(t) > 1)
    names = F.array(*map(F.lit, AMINO))

    def fix(t: Column) -> Column:
        proper = F.initcap(t)
        near = F.filter(names, lambda a: F.levenshtein(proper, a) == 1)
        return F.when(F.array_contains(names, proper), proper).when(F.size(near) == 1, F.try_element_at(near, F.lit(1))).otherwise(t)

    return F.array_join(F.transform(tokens, fix), "")


def normalise_dna(text: Column) -> Column:
    """Bases in small letters: digits and blanks out, u as t, what isn't a base as n."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.lower(text), r"[\s\d]", ""), "u", "t"), "[^acgtn]", "n")


def normalise_protein(text: Column) -> Column:
    """One-letter residues in capitals; what isn't one as X, digits and blanks out."""
    return F.regexp_replace(F.regexp_replace(F.upper(text), r"[\s\d]", ""), "[^ABCDEFGHIKLMNPQRSTVWXYZ]", "X")


@dataclass(frozen=True)
class Element:
    """One position of a motif: the letters that may stand there and how often."""

    letters: str
    least: int = 1
    most: int = 1


def _number(text: str, at: int) -> tuple[int | None, int]:
    end = at
    while end < len(text) and text[end].isascii() and text[end].isdigit():
        end += 1
    return (int(text[at:end]) if end > at else None), end


def motif_elements(motif: str) -> list[Element]:
    """The elements of a motif.

    Grammar: motif = {element}; element = (letter | "[" letters ["]"]) [ "{" number ["," number] ["}"] ].
    What fits nowhere is passed over; a count without a number means once.
    """
    out: list[Element] = []
    at, n = 0, len(motif)
    while at < n:
        ch, at = motif[at], at + 1
        letters = ch
        if ch == "[":
            end = at
            while end < n and motif[end].isascii() and motif[end].isalpha():
                end += 1
            letters, at = motif[at:end], end + (motif[end : end + 1] == "]")
        if not letters.isascii() or not letters.isalpha():
            continue
        least = most = 1
        if motif[at : at + 1] == "{":
            low, end = _number(motif, at + 1)
            if low is not None:
                high, after = _number(motif, end + 1) if motif[end : end + 1] == "," else (None, end)
                least, most = low, low if high is None else high
                at = after + (motif[after : after + 1] == "}")
        out.append(Element("".join(sorted(set(letters))), least, most))
    return out


def motif_sequences(elements: list[Element]) -> Iterator[str]:
    """All sequences of a motif, each once, in ascending order and one at a time: a walk over the states that a prefix can have reached."""

    def settled(states: Iterator[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """The states with those that need no further letter: an element that stands often enough may be left."""
        seen, todo = set(), list(states)
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            i, times = state
            if i < len(elements) and times >= elements[i].least:
                todo.append((i + 1, 0))
        return frozenset(seen)

    if any(e.most < e.least for e in elements):
        return
    stack = [("", settled(iter([(0, 0)])))]
    while stack:
        prefix, states = stack.pop()
        if (len(elements), 0) in states:
            yield prefix
        ahead: dict[str, list[tuple[int, int]]] = {}
        for i, times in states:
            if i < len(elements) and times < elements[i].most:
                for letter in elements[i].letters:
                    ahead.setdefault(letter, []).append((i, times + 1))
        stack += [(prefix + letter, settled(iter(ahead[letter]))) for letter in sorted(ahead, reverse=True)]


def expand_motif(motif: str | None, nucleotide: bool = False, most: int = 100) -> list[str]:
    """The concrete sequences of a motif, the least ``most`` in ascending order: ``[AB]``, ``X{3}``, ``X{2,3}``, and N as any base of a nucleotide.

    Null, empty and unreadable motifs have none.
    """
    elements = motif_elements(motif or "")
    if nucleotide:
        elements = [Element("ACGT", e.least, e.most) if e.letters == "N" else e for e in elements]
    return list(itertools.islice(motif_sequences(elements), most)) if elements else []


def expand_motif_column(motif: Column, nucleotide: bool = False, most: int = 100) -> Column:
    """``expand_motif`` as an Arrow UDF."""
    return pandas_udf(lambda s: s.map(lambda x: expand_motif(x, nucleotide, most)), ArrayType(StringType()))(motif)
