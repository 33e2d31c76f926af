"""Every rule can be reached: what its pattern accepts opens the gate and holds its keyword."""

import itertools
import re
from re import _parser

from scriptorium.llm import license


def samples(parsed):
    """All texts that a parsed pattern accepts; counts and classes are small."""
    parts = []
    for op, value in parsed:
        match str(op):
            case "LITERAL":
                parts.append([chr(value)])
            case "IN":
                parts.append([chr(v) for kind, v in value if str(kind) == "LITERAL"])
            case "BRANCH":
                parts.append([x for branch in value[1] for x in samples(branch)])
            case "SUBPATTERN":
                parts.append(samples(value[-1]))
            case "MAX_REPEAT":
                parts.append([x * n for x in samples(value[2]) for n in range(value[0], value[1] + 1)])
            case _:
                raise ValueError(op)
    return ["".join(x) for x in itertools.product(*parts)]


def test_each_sample_of_a_rule_holds_its_keyword():
    for rule in license.rules():
        for x in samples(_parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, x) and f" {rule.keyword}" in f" {x} ", (x, rule)


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {texts[r["doc_id"]]: r["labels"] for r in license.scan(df).collect()}


def test_names_without_the_familys_word(spark):
    want = {"Licensed under the Expat license": "mit", "distributed under the PSF license": "python", "licensed under 0BSD": "0bsd"}
    assert labels(spark, list(want)) == want


def test_each_sample_of_a_rule_opens_the_gate():
    gate = re.compile(license._gate(license.rules()))
    for rule in license.rules():
        assert all(gate.search(f" {x} ") for x in samples(_parser.parse(rule.pattern))), rule


def test_texts_with_a_common_name_alone(spark):
    want = {
        "released under MIT": "mit", "distributed under mit terms": "mit", "released under isc": "isc", "published under boost": "boost",
        "available under the terms of the ruby": "ruby", "relicensed under mit": "mit", "written in ruby and python": "",
    }
    assert labels(spark, list(want)) == want


def test_sentences_of_license_texts(spark):
    want = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
        "See http://www.apache.org/licenses/LICENSE-2.0 for it": "apache-2",
        "// SPDX-License-Identifier: EPL-2.0": "epl-2",
        "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "redistribution of the seats, and use of sources": "",
    }
    assert labels(spark, list(want)) == want
