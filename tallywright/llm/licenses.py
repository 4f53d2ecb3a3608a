"""License scans by a positional index of rare words, in DataFrame functions only.

Templates are short statements of licences. Their words are weighed by how few
documents hold them (over all documents). A template is looked up through its rarest
words: each place of such a word in a file says where the template would start,
and what the other words of the template say of the same start is added up. A
template is there if the words of its mandatory phrases all stand at their places
and enough of its weight does.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases with their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Statements of licences; mandatory words stand between brackets.
TEMPLATES = {
    "mit": "released under the [mit license]",
    "mit-grant": "[permission is hereby granted free of charge to any person obtaining a copy]",
    "mit-notice": "[the above copyright notice and this permission notice shall be included]",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "apache-url": "[www apache org licenses license 2 0]",
    "gpl-2.0": "this work is licensed under the gnu [general public license version 2]",
    "gpl-3.0": "this work is licensed under the gnu [general public license version 3]",
    "gpl-fsf": "under the terms of the gnu [general public license as published by the free software foundation]",
    "lgpl": "under the terms of the gnu [lesser general public license]",
    "agpl": "under the terms of the gnu [affero general public license]",
    "mpl-2.0": "subject to the terms of the [mozilla public license] v 2 0",
    "bsd": "[redistribution and use in source and binary forms with or without modification are permitted]",
    "isc": "[permission to use copy modify and or distribute this software for any purpose]",
    "cc-by": "licensed under [cc by 4 0]",
    "cc-by-sa": "licensed under [cc by sa 4 0]",
    "cc-by-nc": "licensed under [cc by nc 4 0]",
    "cc-by-nd": "licensed under [cc by nd 4 0]",
    "cc-by-nc-sa": "licensed under [cc by nc sa 4 0]",
    "cc0": "dedicated to the public domain under [cc0 1 0]",
    "unlicense": "[this is free and unencumbered software released into the public domain]",
    "spdx-mit": "[spdx license identifier mit]",
    "spdx-apache": "[spdx license identifier apache 2 0]",
    "spdx-gpl": "[spdx license identifier gpl]",
    "all-rights": "copyright [all rights reserved]",
}

#: A template is looked up through so many of its rarest words.
RARE_WORDS = 2
#: Share of a template's weight that has to stand at its place.
ENOUGH = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(statement: str) -> list[tuple[str, bool]]:
    """Words of a statement, each with whether it is mandatory."""
    words, inside = [], False
    for token in re.findall(r"[\[\]]|[^\s\[\]]+", statement):
        if token in "[]":
            inside = token == "["
        else:
            words.append((token, inside))
    return words


def _postings(templates: dict[str, str]) -> list[tuple[str, int, str, bool]]:
    return [
        (label, place, word, mandatory)
        for label, statement in templates.items()
        for place, (word, mandatory) in enumerate(template_words(statement))
    ]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _words() -> Column:
    """Words of a text in lower case.

    Beyond A-Z, lower case only changes letters that aren't ASCII; the few that become
    ASCII occur in none of the words that are looked up.
    """
    return F.regexp_extract_all(F.lower(_text()), F.lit(WORD), F.lit(0))


def _base_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(at: Column) -> Column:
        found = F.lit(True)
        for shift, part in enumerate(parts):
            found = found & (F.get(words, at + F.lit(shift)) == part)
        return found

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licences of every document, one row per row of ``documents``.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, matches``. ``matches`` lists ``label, word, share``: where each found template
    starts (in words) and how much of its weight stands there. ``score`` is the
    largest such share, 1 if a base phrase is found, 0 if nothing is.

    A null or empty text has no words and no labels. Repeated rows each give a row, a
    null ``doc_id`` stays null, other columns are ignored, an empty table gives no rows.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", _text().alias("text"))
    postings = _postings(templates)
    vocabulary = sorted({word for _, _, word, _ in postings})
    known = F.array(*map(F.lit, vocabulary))

    # How many documents hold each word: as many rows as the templates have words.
    held = dict(
        texts.select(F.explode(F.array_intersect(_words(), known)).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    most = max(held.values(), default=1)
    weight = {word: _log_ratio(most, held.get(word, 0)) for word in vocabulary}
    total = {label: 0.0 for label in templates}
    for label, _, word, _ in postings:
        total[label] += weight[word]
    #: Of each rare word, the templates it stands in and its place there.
    index: dict[str, list[Column]] = {}
    for label in templates:
        own = [(place, word) for name, place, word, must in postings if name == label and must]
        rare = sorted({word for _, word in own}, key=lambda word: (-weight[word], word))[:RARE_WORDS]
        for place, word in own:
            if word in rare:
                index.setdefault(word, []).append(F.struct(F.lit(label).alias("label"), F.lit(place).alias("place")))
    statements = {
        label: F.array(
            *[
                F.struct(
                    F.lit(place).alias("place"),
                    F.lit(word).alias("word"),
                    F.lit(must).alias("must"),
                    F.lit(weight[word] / total[label]).alias("share"),
                )
                for name, place, word, must in postings
                if name == label
            ]
        )
        for label in templates
    }

    worded = texts.select("doc_id", _words().alias("words"))
    matches = _matches(F.col("words"), index, statements)
    based = worded.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *[
            F.when(F.array_contains("words", "license"), _base_places(F.col("words"), phrase))
            .otherwise(F.array().cast("array<int>"))
            .alias(label)
            for phrase, label in BASE.items()
        ],
        F.when(F.arrays_overlap("words", F.array(*map(F.lit, sorted(index)))), matches).alias("matches"),
    )
    labels = list(BASE.values())
    everywhere = F.concat(*labels)
    own_labels = F.filter(
        F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in sorted(labels)]), lambda x: x.isNotNull()
    )
    found = based.select(
        "doc_id",
        "n_words",
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        own_labels.alias("own"),
        F.when(F.size("matches") > 0, F.col("matches")).alias("matches"),
    )
    matched = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", matched)), ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(best).alias("score"),
        "matches",
    )


def _matches(words: Column, index: dict[str, list[Column]], statements: dict[str, Column]) -> Column:
    """Templates that stand in a file: where rare words propose them and the others agree."""
    postings = F.create_map(*[x for word, own in index.items() for x in (F.lit(word), F.array(*own))])
    templates = F.create_map(*[x for label, own in statements.items() for x in (F.lit(label), own)])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda at: F.get(words, at).isin(sorted(index)))
    proposed = F.array_distinct(
        F.flatten(
            F.transform(
                places,
                lambda at: F.transform(
                    postings[F.get(words, at)],
                    lambda one: F.struct(one["label"].alias("label"), (at - one["place"]).alias("word")),
                ),
            )
        )
    )

    def verified(one: Column) -> Column:
        def stands(word: Column) -> Column:
            return F.coalesce(F.get(words, one["word"] + word["place"]) == word["word"], F.lit(False))

        statement = templates[one["label"]]
        whole = F.forall(statement, lambda word: ~word["must"] | stands(word))
        share = F.aggregate(
            statement, F.lit(0.0), lambda held, word: held + F.when(stands(word), word["share"]).otherwise(0.0)
        )
        return F.struct(one["label"].alias("label"), one["word"].alias("word"), F.when(whole, F.least(share, F.lit(1.0))).alias("share"))

    return F.array_sort(F.filter(F.transform(proposed, verified), lambda one: one["share"] >= ENOUGH))


def _log_ratio(most: int, held: int) -> float:
    return log(1 + (most + 1) / (held + 0.5))
