"""Sentences of texts in the scripts of the corpus."""

from __future__ import annotations

import re

# An end mark, closing quotes, blank, then anything that is no small letter; or an East Asian end mark.
_END = re.compile(r"""(?<![\s.(]\w)(?<!\bNo)(?<!\bDr)(?<!\bMr)(?<!\bSt)(?<!\bvs)(?<!\bca)(?<!\bNr)[.!?…]+["'»”’)\]]*\s+(?=[^\sa-zà-öø-ÿа-я])|[。！？…]+["'」』”’）]*|[\r\n]+""")


def split_sentences(text: str | None) -> list[str]:
    """The sentences of a text without outer blanks; null and blank texts have none."""
    if not text:
        return []
    out, last = [], 0
    for m in _END.finditer(text):
        out.append(text[last : m.end()].strip())
        last = m.end()
    out.append(text[last:].strip())
    return [x for x in out if x]
