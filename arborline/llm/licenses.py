r"""License scan by ordered signature rules, in DataFrame functions only.

A cheap pattern finds texts with any license vocabulary. Only there are words normalised (A-Z lower, joined by single
spaces) and dealt to chunks of OWN words with CONTEXT words on both sides, which no match exceeds; a chunk without that
vocabulary goes. In a chunk the rules whose keyword occurs are run (some keywords run on, see PARTS). A rule is found at
every word where its pattern matches; a chunk reports what begins among its own words, so the work is linear in a text.
Of overlapping detections, one that lies inside another of at least its own priority is suppressed (of equal places the
higher priority stays, then the earlier rule).

Defined results: a null or empty text has no words, no detections, empty labels and score 0; a null id is
kept; repeated rows are scanned alike; whole texts are read, however long. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered, and what separates them.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Every phrase and every rule contains one of these; the rest of a corpus pays for this pattern alone.
GATE = rf"(?i)licen[cs]|copyright|warrant|redistribut|advertising|hereby{BREAK}granted|spdx|rights|copyleft|cc0|public{BREAK}domain|cc{BREAK}by|creative{BREAK}commons"

# Families: label, keyword (a word that any match has, or in PARTS a part of one), and how the name is written.
FAMILIES = [
    ("mit", "mit", r"mit(?: expat| x11)?"),
    ("expat", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|(?:4|four) clause bsd|original bsd|old bsd)"),
    ("bsd", "berkeley", r"berkeley software distribution"),
    ("bsd", "bsd", r"bsd"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: v| version)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: v| version)? ?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: v| version)? 2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: v| version)? 3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: v| version)? ?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: v| version)? ?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl", "general", r"(?:gnu )?(?:lesser|library) general public"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: v| version)? ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: licen[cs]e)?(?: v| version)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: licen[cs]e)?(?: v| version)? 2(?: 0)?"),
    ("mpl", "mpl", r"mpl(?: 2 0| 1 1)?"),
    ("epl-1.0", "eclipse", r"eclipse public(?: licen[cs]e)?(?: v| version)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public(?: licen[cs]e)?(?: v| version)? 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl", "cddl", r"cddl(?: 1 0| 1 1)?"),
    ("cddl", "distribution", r"common development and distribution"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("artistic", "artistic", r"(?:perl )?artistic(?: 1 0| 2 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("boost", "boost", r"boost(?: software)?(?: 1 0)?"),
    ("python", "python", r"python(?: software foundation)?"),
    ("eupl", "eupl", r"eupl(?: 1 1| 1 2)?"),
    ("ofl", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl", "font", r"(?:sil )?open font"),
    ("odbl", "database", r"open database|odc open database"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: \d 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: \d 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: \d 0)?"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by", "commons", r"creative commons attribution(?: \d 0)?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: \d 0)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: \d 0)?"),
]

# Wordings around a name, the most telling first: priority, and the pattern.
WORDINGS = [
    (5, r"spdx license identifier {n}(?: only| or later)?"),
    (5, r"licen[cs]ed under(?: the)?(?: terms of(?: the)?)? {n}(?: public)?(?: licen[cs]e)?(?: v| version)?(?: \d(?: \d)?)?"),
    (4, r"(?:released|distributed|published|available|provided) under(?: the)?(?: terms of(?: the)?)? {n} licen[cs]e"),
    (4, r"subject to(?: the terms of)?(?: the)? {n} licen[cs]e"),
    (3, r"(?:licen[cs]e|licen[cs]ing) {n}"),
    (2, r"{n} licen[cs]e[ds]?"),
]

# Wordings of no family: label, keyword, priority, pattern.
OTHERS = [
    ("cc-by-nc", "nc", 3, r"cc by nc(?: \d 0)?"),
    ("cc-by-sa", "sa", 3, r"cc by sa(?: \d 0)?"),
    ("cc-by-nd", "nd", 3, r"cc by nd(?: \d 0)?"),
    ("cc0", "cc0", 3, r"cc0(?: 1 0)?"),
    ("gpl-2.0", "general", 3, r"gnu general public license(?: v| version)? 2(?: 0)?"),
    ("gpl-3.0", "general", 3, r"gnu general public license(?: v| version)? 3(?: 0)?"),
    ("lgpl", "lesser", 3, r"(?:gnu )?lesser general public license"),
    ("agpl", "affero", 3, r"(?:gnu )?affero general public license"),
    ("public-domain", "domain", 3, r"(?:in|into|to) the public domain"),
    ("public-domain", "domain", 2, r"public domain"),
    ("copyleft", "copyleft", 2, r"copyleft"),
    ("reserved", "reserved", 3, r"all rights reserved(?: worldwide)?"),
    ("some-reserved", "reserved", 3, r"some rights reserved"),
    ("no-reserved", "reserved", 3, r"no rights reserved"),
    ("copyright-notice", "copyright", 1, r"copyright (?:c )?(?:19|20)\d\d"),
    ("permission-notice", "permission", 4, r"permission is hereby granted free of charge(?: (?:\S+ ){{0,12}}copyright| to any person(?: or organization)? obtaining a copy)"),
    ("permission-notice", "notice", 3, r"the above copyright notice and this permission notice"),
    ("bsd", "redistributions", 4, r"redistributions of source code must retain the above copyright"),
    ("proprietary", "proprietary", 3, r"proprietary (?:and confidential )?licen[cs]e"),
    ("commercial", "commercial", 3, r"commercial licen[cs]e"),
    # sentences of the license texts themselves
    ("mit", "restriction", 4, r"to deal in the software without restriction including without limitation the rights"),
    ("mit", "sublicense", 4, r"rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "merchantability", 2, r"without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "fee", 4, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", 2, r"the author disclaims all warranties with regard to this software"),
    ("bsd", "binary", 4, r"redistributions in binary form must reproduce the above copyright"),
    ("bsd", "permitted", 3, r"redistribution and use in source and binary forms(?: with or without modification)?(?: are)? permitted"),
    ("bsd-4-clause", "advertising", 4, r"all advertising materials mentioning features or use of this software must display the following (?:acknowledgement|copyright notice)"),
    ("as-is", "warranties", 2, r"any express or implied warranties including but not limited to"),
    ("as-is", "warranty", 2, r"(?:provided|distributed|licensed)(?: on an)? as is(?: basis)? without(?: any)? warranty"),
    ("as-is", "warranties", 2, r"(?:provided|distributed|licensed)(?: on an)? as is(?: basis)? without(?: any)? warranties"),
    ("as-is", "warranties", 2, r"without warranties or conditions of any kind either express or implied"),
    ("as-is", "warranty", 1, r"there is no warranty"),
    ("as-is", "warranty", 1, r"no warranty(?: of any kind)?(?: is)? (?:given|provided|expressed|implied)"),
    ("gpl", "redistribute", 3, r"this program is free software you can redistribute it and or modify it under the terms"),
    ("gpl", "warranty", 3, r"without even the implied warranty of merchantability"),
    ("gpl", "gnu", 4, r"under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu", 4, r"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "gnu", 4, r"gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "later", 4, r"gpl(?: v| version)? ?2 or(?: any)? later licen[cs]e"),
    ("gpl", "copy", 3, r"you should have received a copy of the gnu general public license"),
    ("lgpl", "copy", 3, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "gnu", 4, r"under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "gnu", 4, r"gnu lesser general public license(?: v| version)? 2 1"),
    ("lgpl-3.0", "gnu", 4, r"gnu lesser general public license(?: v| version)? 3(?: 0)?"),
    ("agpl", "copy", 3, r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "gnu", 4, r"gnu affero general public license(?: v| version)? 3(?: 0)?"),
    ("gfdl", "documentation", 3, r"(?:gnu )?free documentation license"),
    ("apache-2.0", "compliance", 4, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", 4, r"licen[cs]ed under the apache licen[cs]e version 2(?: 0)?"),
    ("apache-2.0", "obtain", 2, r"you may obtain a copy of the license at"),
    ("apache-2.0", "permissions", 3, r"see the license for the specific language governing permissions and limitations"),
    ("apache", "asf", 4, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mpl", "mozilla", 3, r"subject to the terms of the mozilla public license"),
    ("mpl-2.0", "mozilla", 4, r"subject to the terms of the mozilla public license v(?:ersion)? 2(?: 0)?"),
    ("mpl-1.1", "mozilla", 4, r"subject to the mozilla public license version 1 1"),
    ("epl", "eclipse", 3, r"(?:the )?terms of the eclipse public license"),
    ("epl-1.0", "eclipse", 4, r"terms of the eclipse public license v(?:ersion)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", 4, r"terms of the eclipse public license v(?:ersion)? ?2(?: 0)?"),
    ("cddl", "development", 4, r"subject to the terms of the common development and distribution license"),
    ("boost", "boost", 4, r"distributed under the boost software license(?: version 1 0)?"),
    ("unlicense", "unencumbered", 4, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", 3, r"dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "want", 3, r"do what the fuck you want to public license"),
    ("artistic", "artistic", 4, r"the artistic licen[cs]e(?: 1 0| 2 0)?"),
    ("python", "psf", 3, r"psf licen[cs]e(?: agreement)?"),
    ("eupl", "european", 3, r"european union public licen[cs]e(?: v ?1 \d)?"),
    ("ofl", "sil", 4, r"sil open font licen[cs]e(?: version 1 1)?"),
    ("odbl", "database", 4, r"open (?:data commons )?open database licen[cs]e"),
    ("odbl", "odbl", 3, r"odbl licen[cs]e"),
    ("pddl", "commons", 3, r"open data commons public domain dedication(?: and)? licen[cs]e"),
    ("ms-pl", "microsoft", 3, r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", 3, r"microsoft reciprocal licen[cs]e"),
    ("postgresql", "postgresql", 3, r"postgresql licen[cs]e"),
    ("openssl", "openssl", 3, r"openssl licen[cs]e"),
    ("php", "php", 3, r"php licen[cs]e(?: v| version)?(?: 3(?: 01?)?)?"),
    ("ruby", "ruby", 3, r"ruby licen[cs]e"),
    ("vim", "vim", 3, r"vim licen[cs]e"),
    ("curl", "curl", 3, r"curl licen[cs]e"),
    ("beerware", "beer", 3, r"(?:the )?beer ware licen[cs]e"),
    ("beerware", "beerware", 3, r"beerware licen[cs]e"),
    ("cc-by", "attribution", 4, r"creative commons attribution(?: \d 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-sa", "attribution", 4, r"creative commons attribution share ?alike(?: \d 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc", "attribution", 4, r"creative commons attribution non ?commercial(?: \d 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nd", "attribution", 4, r"creative commons attribution no ?deriv(?:ative)?s(?: \d 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc-sa", "attribution", 4, r"creative commons attribution non ?commercial share ?alike(?: \d 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc-nd", "attribution", 4, r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc0", "universal", 4, r"cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0", "waived", 3, r"(?:has|have) waived all copyright and related(?: or neighboring)? rights"),
    ("creative-commons", "commons", 2, r"(?:a |the )?creative commons(?: public)? licen[cs]e"),
    ("creative-commons", "commons", 1, r"some rights reserved creative commons"),
    ("public-domain", "copyright", 3, r"(?:no|without)(?: known)? copyright(?: restrictions)?"),
    ("public-domain", "copyright", 3, r"not (?:protected by|subject to) copyright"),
    ("public-domain", "dedicated", 4, r"(?:is |are |has been |hereby )?dedicated to the public domain"),
    ("reserved", "rights", 3, r"(?:all|any) (?:other )?rights (?:are )?(?:strictly |expressly )?reserved"),
    ("proprietary", "confidential", 3, r"proprietary and confidential(?: copyright| all rights reserved)"),
    ("proprietary", "agreement", 2, r"end user licen[cs]e agreement"),
    ("proprietary", "agreement", 2, r"software licen[cs]e agreement"),
    ("proprietary", "non", 2, r"non transferable licen[cs]e"),
    ("proprietary", "nontransferable", 2, r"nontransferable licen[cs]e"),
    ("proprietary", "revocable", 2, r"(?:limited )?revocable licen[cs]e"),
    ("dual", "dual", 3, r"dual licen[cs]ed"),
    ("dual", "dual", 3, r"dual licen[cs]e(?: of| under)?"),
    ("fair-use", "fair", 2, r"fair use (?:of )?copyright(?:ed)?(?: material)?"),
    ("copyright-notice", "copyright", 1, r"copyright by"),
    ("copyright-notice", "copyright", 1, r"copyright holders?"),
    ("copyright-notice", "notice", 2, r"copyright notice"),
    ("copyright-notice", "statement", 2, r"copyright statement"),
]
LEVELS = 5
#: Words a chunk reports on, and words around them that it sees; no pattern matches more words than CONTEXT.
OWN, CONTEXT = 400, 40

#: Keywords that a match may write as part of a longer word (gpl2, freebsd), and what of the text is looked for then.
PARTS = {"apache": " apache", "bsd": "bsd ", "gpl": " gpl", "lgpl": " lgpl", "agpl": " agpl"}


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, pattern) in order; a pattern matches whole words of normalised text."""
    made = [(label, word, p, w.replace("{n}", f"(?:{name})")) for p, w in WORDINGS for label, word, name in FAMILIES]
    made += [(label, word, p, pattern.replace("{{", "{").replace("}}", "}")) for label, word, p, pattern in OTHERS]
    return [(label, word, p, rf"(?<= ){pattern}(?= )") for label, word, p, pattern in made]


def sign(word: str) -> str:
    """What normalised text has wherever a rule of this keyword matches."""
    return PARTS.get(word, f" {word} ")


def normalised(text: Column) -> Column:
    """' word word ': A-Z lowered, one space between words and at both ends."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.translate(F.regexp_replace(text, BREAK, " "), upper, upper.lower())
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaces(s: str) -> str:
    return f"(octet_length({s}) - octet_length(replace({s}, ' ', '')))"


def _places(pattern: str, text: str) -> str:
    """SQL for the places (first word, word after the last) where a pattern of single-spaced ``text`` begins."""
    hits = f"regexp_extract_all({text}, concat('(?=(', {pattern}, '))'), 1)"
    # words before a match: the spaces of all pieces before it, less the leading one
    pieces = f"split({text}, concat('(?=', {pattern}, ')'), -1)"
    step = f"named_struct('at', acc.at + {_spaces('e.g')}, 'found', IF(e.h IS NULL, acc.found, array_append(acc.found, named_struct('first', acc.at + {_spaces('e.g')}, 'last', acc.at + {_spaces('e.g')} + {_spaces('e.h')} + 1))))"
    fold = f"aggregate(zip_with({pieces}, hits, (g, h) -> named_struct('g', g, 'h', h)), named_struct('at', -1, 'found', {_NONE}), (acc, e) -> {step}, acc -> acc.found)"
    return f"get(transform(array({hits}), hits -> IF(size(hits) = 0, {_NONE}, {fold})), 0)"


_NONE = "cast(array() AS array<struct<first:int,last:int>>)"


def _pattern(rule: str) -> str:
    """A rule's pattern as it is searched for: whole words."""
    return rf"(?<= ){rule}(?= )"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places with labels) and detections (after suppression) of every document."""
    table = ",".join(f"named_struct('nth',{i},'label',{_quoted(a)},'word',{_quoted(sign(w))},'priority',{p},'pattern',{_quoted(r)})" for i, (a, w, p, r) in enumerate(rules()))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(F.col("text").rlike(GATE), F.split(F.trim(normalised(F.col("text"))), " ")).alias("ws"))
    chunks = f"""filter(transform(sequence(0, cast(floor((size(ws) - 1) / {OWN}) AS int)), k -> named_struct('own', k * {OWN}, 'seen', greatest(k * {OWN} - {CONTEXT}, 0),
        'text', concat(' ', array_join(slice(ws, greatest(k * {OWN} - {CONTEXT}, 0) + 1, (k + 1) * {OWN} + {CONTEXT} - greatest(k * {OWN} - {CONTEXT}, 0)), ' '), ' '))), c -> c.text RLIKE {_quoted(GATE)})"""
    rows = rows.select("doc_id", "n_words", F.expr(f"IF(ws IS NOT NULL, {chunks}, NULL)").alias("chunks"))
    own = lambda x: f"{x}.first + c.seen >= c.own AND {x}.first + c.seen < c.own + {OWN}"
    base = " , ".join(f"transform({_places(_quoted(_pattern(phrase)), 'c.text')}, x -> named_struct('first', x.first, 'label', {_quoted(label)}))" for phrase, label in BASE.items())
    base = f"flatten(transform(chunks, c -> transform(filter(concat({base}), x -> {own('x')}), x -> named_struct('first', x.first + c.seen, 'label', x.label))))"
    found = f"""sort_array(flatten(transform(filter(array({table}), r -> contains(c.text, r.word)), r ->
        transform({_places("r.pattern", "c.text")}, x -> named_struct('first', x.first, 'back', -x.last, 'low', -r.priority, 'nth', r.nth, 'label', r.label)))))"""
    # furthest end so far of each priority: a detection that ends no later than one of its priority or more lies inside it
    kept = f"""aggregate({found}, named_struct('ends', array_repeat(0, {LEVELS}), 'kept', cast(array() AS array<struct<first:int,last:int,label:string,priority:int>>)),
      (acc, d) -> named_struct(
        'ends', transform(acc.ends, (x, i) -> IF(i = -d.low - 1, greatest(x, -d.back), x)),
        'kept', IF(NOT ({own('d')}) OR exists(slice(acc.ends, -d.low, {LEVELS}), x -> x >= -d.back), acc.kept,
                   array_append(acc.kept, named_struct('first', d.first + c.seen, 'last', c.seen - d.back, 'label', d.label, 'priority', -d.low)))),
      acc -> acc.kept)"""
    return rows.select("doc_id", "n_words", F.expr(base).alias("base"), F.expr(f"flatten(transform(chunks, c -> {kept}))").alias("detections"))


def license_report(docs: DataFrame) -> DataFrame:
    """A row for each document: base places and labels, all labels, and a score (the best surviving priority, base phrases counting 2, over 5)."""
    d = scan(docs)
    base = F.coalesce("base", F.expr("cast(array() AS array<struct<first:int,label:string>>)"))
    labels = lambda c: F.sort_array(F.array_distinct(c))
    every = F.array_union(base["label"], F.coalesce(F.col("detections.label"), F.array().cast("array<string>")))
    best = F.greatest(F.coalesce(F.array_max("detections.priority"), F.lit(0)), F.when(F.size(base) > 0, 2).otherwise(0))
    return d.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).cast("long").alias("first_word"), F.array_max(base["first"]).cast("long").alias("last_word"),
        F.array_join(labels(base["label"]), ",").alias("base_labels"), F.array_join(labels(every), ",").alias("labels"), (best / F.lit(float(LEVELS))).alias("score"),
    )
