"""License scan: templates in markup, compiled to token automata.

A template is a text with two kinds of regions: ``<<optional>> ... <<end>>`` may be left out, ``<<any N>>`` stands
for up to N words of any kind. All other words are mandatory and must stand in this order with nothing between.
A template starts with a mandatory word. It is compiled to an automaton whose states are places between tokens;
a document is accepted where some path from a start word reaches the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from alertfold.llm.wordstream import as_rows

# fixed values: phrases of the contract and their labels
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# fixed values: names of licenses and their labels; the base where the caller has no phrases of their own
NAMES = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# fixed values: wording of public licenses and their notices, as templates
TEMPLATES = {
    "agpl-3": "gnu affero general public license <<optional>> as published by the free software foundation <<any 3>>"
    " <<end>> <<optional>> either <<end>> <<optional>> version <<end>> 3",
    "apache-2-notice": "licensed under the apache license <<optional>> version <<end>> 2 <<optional>> 0 <<end>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted"
    " <<optional>> provided that the following conditions are met <<end>>",
    "bsd-notice": "under <<optional>> the terms of <<end>> <<optional>> the <<end>> bsd <<any 2>> license",
    "cc-by-nc-4": "cc by nc <<optional>> sa <<end>> <<optional>> nd <<end>> 4 0",
    "cc-by-sa": "creative commons attribution <<optional>> non commercial <<end>> share alike",
    "copyright": "copyright <<any 8>> all rights reserved",
    "gpl-2": "gnu general public license <<optional>> as published by the free software foundation <<any 3>> <<end>>"
    " version 2",
    "gpl-3": "gnu general public license <<optional>> as published by the free software foundation <<any 3>> <<end>>"
    " version 3",
    "lgpl": "gnu lesser general public license <<optional>> version <<any 2>> <<end>>",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software"
    " <<optional>> and associated documentation files the software <<end>> to deal in the software without"
    " restriction",
    "mit-notice": "released under the <<optional>> terms of the <<end>> mit license",
    "mpl-2": "mozilla public license <<optional>> v <<end>> <<optional>> version <<end>> 2 <<optional>> 0 <<end>>",
    "proprietary": "all rights reserved",
    "public-domain": "free and unencumbered software released into the public domain",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PART = re.compile(r"<<optional>>|<<end>>|<<any (\d+)>>|\S+")
_ANY = None


@dataclass(frozen=True)
class Automaton:
    """``steps[state]``: tokens (None: any) and the states behind them. State 0 is the start."""

    first: bytes
    mandatory: frozenset[bytes]
    steps: list[list[tuple[bytes | None, int]]]
    accepting: frozenset[int]

    def end(self, words: list[bytes], at: int) -> int | None:
        """The word behind the shortest accepted run that starts at ``at``, or None."""
        states = {0}
        while states:
            if states & self.accepting:
                return at
            if at == len(words):
                return None
            word = words[at]
            states = {to for s in states for token, to in self.steps[s] if token is _ANY or token == word}
            at += 1
        return None


def compiled(template: str) -> Automaton:
    """The automaton of a template, without empty steps.

    ``skips`` are the empty steps over optional regions and unused wildcards; they are closed at the end.
    """
    tokens: list[tuple[int, bytes | None, int]] = []
    skips: list[tuple[int, int]] = []
    opened: list[int] = []
    mandatory: list[bytes] = []
    state = 0
    for part in _PART.finditer(template):
        if part[0] == "<<optional>>":
            opened.append(state)
        elif part[0] == "<<end>>":
            skips.append((opened.pop(), state))
        elif part[1]:
            left = state + int(part[1])
            skips += [(s, left) for s in range(state, left)]
            tokens += [(s, _ANY, s + 1) for s in range(state, left)]
            state = left
        else:
            word = part[0].encode()
            if not opened:
                mandatory.append(word)
            tokens.append((state, word, state + 1))
            state += 1
    if opened or not mandatory or tokens[0][1] != mandatory[0]:
        raise ValueError(f"a template starts with a mandatory word and closes its regions: {template!r}")
    reach = [{s} for s in range(state + 1)]
    for low, high in sorted(skips, reverse=True):
        reach[low] |= reach[high]
    steps: list[list[tuple[bytes | None, int]]] = [[] for _ in reach]
    for low, token, high in tokens:
        for s, within in enumerate(reach):
            if low in within:
                steps[s].append((token, high))
    accepting = frozenset(s for s, within in enumerate(reach) if state in within)
    return Automaton(mandatory[0], frozenset(mandatory), steps, accepting)


class Scanner:
    """All templates and base phrases, compiled."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.base = [(label, compiled(text)) for text, label in phrases.items()]
        self.templates = [(label, compiled(text)) for label, text in templates.items()]

    def places(self, words: list[bytes]) -> Iterator[tuple[bool, str, int, int, int]]:
        """(is base, label, first word, word behind the last, mandatory words) of every match."""
        present = set(words)
        for is_base, known in ((True, self.base), (False, self.templates)):
            for label, automaton in known:
                if automaton.mandatory <= present:
                    at = -1
                    for _ in range(words.count(automaton.first)):
                        at = words.index(automaton.first, at + 1)
                        end = automaton.end(words, at)
                        if end is not None:
                            yield is_base, label, at, end, len(automaton.mandatory)


_PLACE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = NAMES) -> DataFrame:
    """Per row of ``docs``: row (all its columns), n_words, places, score.

    ``places`` are all matches: label, whether it is a base phrase, first and last word from 0. ``score`` is
    m / (m + 1) for the largest number m of distinct mandatory words of a template or phrase that matches, 0
    without a match. Null and empty texts have no words. Rows are independent; nothing is shuffled.
    """
    rows = as_rows(docs)
    schema = f"{rows.schema.simpleString()[7:-1]},n_words:bigint,"
    schema += "places:array<struct<label:string,base:boolean,first:bigint,last:bigint>>,score:double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            counts, places, scores = [], [], []
            for text in pc.struct_field(batch.column("row"), "text").cast(pa.large_binary()):
                words = _WORD.findall((text.as_py() or b"").lower())
                found = list(scanner.places(words))
                counts.append(len(words))
                places.append([(label, base, low, high - 1) for base, label, low, high, _ in found])
                most = max((f[4] for f in found), default=0)
                scores.append(most / (most + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(scores)],
                ["row", "n_words", "places", "score"],
            )

    return rows.mapInArrow(run, schema)
