"""License scans by conditional compression.

Candidate blocks come from the templates themselves: a text's words are looked up in an index of the templates' word triples, and
where enough of one template's triples stand in order, the stretch of words that the template would take there is a block. No list of
cue words decides. Each block is compressed with every template as zstandard raw dictionary; templates rank by how much smaller that
makes it. Those that save bytes are confirmed by exact wording differences: the longest alignment of words tells which were left
out, put in or changed. A block is its template's if at least `least` of the template's words stand in it in order, with at most
`more` as many others between them, no number (a version, a term) is missing and one of its triples is whole. Several licences may stand in one stretch; words that
stand for one don't count for the next, the one with most words goes first.

A stretch that is confirmed has at least (least - 2 more) of its template's triples intact, less the two at its ends and two for each
of them; blocks with fewer are not compressed. Costs grow with a text's length, not its square: blocks are no longer than their
template allows.

Templates are a parameter (a dict, or a folder of text files). Blocks repeat across documents, so sizes are remembered by block,
in bounded memory. Defined cases: null and empty texts have no blocks; ties between templates go to the one listed first; repeated
rows are scanned alike; an empty table gives an empty result. No text is cut short.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import count
from math import ceil
from pathlib import Path

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: One-line notices and grants (fixed wordings of public licences); longer texts are in the folder `templates`.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "proprietary": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-+][A-Za-z0-9]+)*")
_LOWER = re.compile(rb"[a-z0-9]+(?:[.\-+][a-z0-9]+)*")


def read_templates(folder: str | Path = Path(__file__).parent / "templates") -> dict[str, str]:
    """Templates by file name (without .txt)."""
    return {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.txt"))}


def default_templates() -> dict[str, str]:
    return {f"{k}-text": v for k, v in read_templates().items()} | NOTICES


def words_of(text: str) -> list[bytes]:
    """Lower-case words: ASCII letters and digits, with dots, hyphens and plus signs inside."""
    return _LOWER.findall(text.encode(errors="surrogatepass").lower())


def alignment(words: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """(place in words, place in template) of equal words in order: as many as can be, numbers before all others, and with the fewest other words between them.

    Goes through the pairs of equal words once; a tree of maxima over the template's places gives each one its best predecessor.
    """
    places: dict[bytes, list[int]] = {}
    for j, w in enumerate(template):
        places.setdefault(w, []).append(j)
    gap, number = 0.5 / (len(words) + 1), len(template) + 1.0
    tree: list[tuple[float, tuple | None]] = [(float("-inf"), None)] * (len(template) + 1)
    best: tuple[float, tuple | None] = (0.0, None)
    for i, w in enumerate(words):
        for j in reversed(places.get(w, ())):
            before, k = (float("-inf"), None), j  # places under j
            while k > 0:
                before = max(before, tree[k], key=lambda x: x[0])
                k -= k & -k
            score = (number if w[:1].isdigit() else 1.0) + max(0.0, before[0] - gap * i)
            link = (i, j, before[1] if before[0] - gap * i > 0 else None)
            best = max(best, (score, link), key=lambda x: x[0])
            k, value = j + 1, score + gap * (i + 1)
            while k < len(tree):
                if value > tree[k][0]:
                    tree[k] = value, link
                k += k & -k
    out, link = [], best[1]
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


class Scanner:
    """The templates' index and compressors; remembers the sizes of `known` short blocks at most."""

    def __init__(self, templates: dict[str, str], least: float = 0.9, more: float = 0.25, level: int = 3, known: int = 50_000):
        self.names, self.least, self.more, self.limit = list(templates), least, more, known
        self.words = [words_of(t) for t in templates.values()]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates.values()]
        #: By length of a word run (3, or that of a shorter template): the runs, and each one's templates and places in them.
        self.runs: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for t, words in enumerate(self.words):
            n = min(3, len(words))
            for i in range(len(words) - n + 1) if n else ():
                self.runs.setdefault(n, {}).setdefault(tuple(words[i : i + n]), []).append((t, i))
        self.own = [{tuple(w[i : i + min(3, len(w))]) for i in range(max(len(w) - 2, 1))} for w in self.words]
        self.sizes: dict[str, list[int]] = {}

    def put_in(self, t: int) -> int:
        """Most words that may stand between a template's."""
        return max(2, int(self.more * len(self.words[t])))

    def needed(self, t: int) -> int:
        """Fewest of a template's runs that a confirmed stretch has intact."""
        m = len(self.words[t])
        return max(1, m - min(3, m) + 1 - 3 * (m - ceil(self.least * m)) - 2 * self.put_in(t))

    def stretches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, last word (exclusive)): where enough of a template's runs stand in order."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for n, runs in self.runs.items():
            grams = list(zip(*(words[i:] for i in range(n))))
            if not runs.keys().isdisjoint(grams):
                for i, gram in enumerate(grams):
                    for t, place in runs.get(gram, ()):
                        hits.setdefault(t, []).append((i, place))
        out = set()
        for t, own in sorted(hits.items()):
            m, slack, need = len(self.words[t]), self.put_in(t), self.needed(t)
            # Chains of hits that a copy of the template could make, one for each place where a copy could begin.
            chains: dict[int, list[int]] = {}  # begin, rounded to the slack: first begin, last begin, hits
            for i, place in own:
                chains.setdefault((i - place) // (slack + 1), []).append(i - place)
            for k in sorted(chains):
                begins = chains[k] + chains.get(k + 1, []) + chains.get(k + 2, [])  # words put in move later hits on
                if len(begins) >= need:
                    out.add((t, max(min(chains[k]) - slack, 0), min(max(begins) + m + slack, len(words))))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def saved(self, block: str) -> list[int]:
        """Bytes that each template as dictionary saves on a block."""
        if block in self.sizes:
            return self.sizes[block]
        raw = block.encode(errors="surrogatepass")
        size = len(self.plain.compress(raw))
        out = [size - len(c.compress(raw)) for c in self.given]
        if len(block) <= 512:
            if len(self.sizes) >= self.limit:
                self.sizes.clear()
            self.sizes[block] = out
        return out

    def confirm(self, t: int, words: list[bytes]) -> tuple[list[int], int, int] | None:
        """(places of the template's words in `words`, words left out, words put in), or None if they differ too much."""
        template = self.words[t]
        n = min(3, len(template))
        if self.own[t].isdisjoint(zip(*(words[i:] for i in range(n)))):
            return None
        pairs = alignment(words, template)
        while len(pairs) >= self.least * len(template):
            put_in = pairs[-1][0] - pairs[0][0] + 1 - len(pairs)
            if put_in <= self.put_in(t):
                have = {j for _, j in pairs}
                if any(w[:1].isdigit() and j not in have for j, w in enumerate(template)):
                    return None
                return [i for i, _ in pairs], len(template) - len(pairs), put_in
            # a word at an end that stands far from the others is left out
            del pairs[-1 if len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > pairs[1][0] - pairs[0][0] else 0]
        return None

    def scan(self, text: str) -> list[tuple]:
        """(licence, start, end, bytes saved, rank by bytes saved, words kept, words of the template, words out, words in) of each confirmed stretch, by start."""
        words = words_of(text)
        found = self.stretches(words)
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        order, queue = count(), []

        def offer(t: int, lo: int, hi: int, saved: int, rank: int) -> None:
            ok = self.confirm(t, words[lo:hi])
            if ok:
                places = [lo + i for i in ok[0]]
                heappush(queue, (-len(places), ok[1] + ok[2], t, lo, hi, next(order), places, ok[1], ok[2], saved, rank))

        for t, lo, hi in found:
            sizes = self.saved(text[spans[lo][0] : spans[hi - 1][1]])
            if sizes[t] > 0:
                offer(t, lo, hi, sizes[t], 1 + sum(s > sizes[t] for s in sizes))
        heapify(queue)
        out = []
        while queue:
            _, _, t, lo, hi, _, places, left, put_in, saved, rank = heappop(queue)
            if any(not words[i] for i in places):  # some of its words stand for another
                offer(t, lo, hi, saved, rank)
                continue
            out.append((self.names[t], spans[places[0]][0], spans[places[-1]][1], saved, rank, len(places), len(self.words[t]), left, put_in))
            for i in places:
                words[i] = b""
            offer(t, lo, hi, saved, rank)  # there may be one more
        return sorted(out, key=lambda r: (r[1], r[2], r[0]))


_scanners: dict[str, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each confirmed stretch: doc_id, license, start, end (code points, end exclusive), saved_bytes, saved_rank, words_kept, words_template, words_out, words_in, exact."""
    templates = default_templates() if templates is None else templates
    key = repr(templates)

    def run(texts: list) -> tuple:
        if key not in _scanners:
            _scanners[key] = Scanner(templates)
        rows, out = [], []
        for i, text in enumerate(texts):
            for r in _scanners[key].scan(text or ""):
                rows.append(i)
                out.append((*r, r[7] + r[8] == 0))
        return rows, list(zip(*out)) if out else [[]] * 10

    return map_texts(docs, ["doc_id"], run, "license string, start long, end long, saved_bytes long, saved_rank long, words_kept long, words_template long, words_out long, words_in long, exact boolean")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
