"""License scans by ordered signature rules, in DataFrame operations only.

A text becomes its words (ASCII letters and digits and everything beyond ASCII), lower-cased A-Z and
joined by single spaces, with a space at both ends. Texts without any keyword stop at one pattern. In
the others each rule whose own keyword occurs reports its places as intervals of words. A detection
inside a longer one goes; of equal intervals the rule with the better priority, then the earlier one,
stays. Everything happens within the row: nothing is shuffled and nothing grows with the corpus.

Null and empty texts have no words, no labels and score 0. Repeated rows get equal results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import let, once

#: The contract's phrases.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
HITS = "array<struct<start:int,minus_end:int,priority:int,rule:int,label:string,weight:double>>"
ANY_BASE = "(?<= )(?:" + "|".join(BASE) + ")(?= )"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


#: label, keyword, names of the license as patterns over words.
FAMILIES = [
    ("mit", "mit", ["mit"]),
    ("mit", "expat", ["expat"]),
    ("mit-0", "mit", ["mit no attribution", "mit 0"]),
    ("x11", "x11", ["x11", "mit x11"]),
    ("apache-1", "apache", ["apache (?:software )?license version 1(?: 0)?", "apache 1 0"]),
    ("apache-1.1", "apache", ["apache (?:software )?license version 1 1", "apache 1 1"]),
    ("apache-2", "apache", ["apache (?:software )?license v?(?:ersion )?2(?: 0)?", "apache v?2(?: 0)?"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause", "(?:simplified|freebsd) bsd", "two clause bsd"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause", "(?:new|modified|revised) bsd", "three clause bsd"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause", "(?:original|old) bsd", "four clause bsd"]),
    ("0bsd", "0bsd", ["0bsd"]),
    ("0bsd", "bsd", ["zero clause bsd", "bsd zero clause"]),
    ("gpl-1", "general public", ["gnu general public license v(?:ersion )?1(?: 0)?"]),
    ("gpl-2", "general public", ["gnu general public license v(?:ersion )?2(?: 0)?"]),
    ("gpl-3", "general public", ["gnu general public license v(?:ersion )?3(?: 0)?"]),
    ("gpl-2-short", "gpl", ["(?:gnu )?gpl v?2(?: 0)?(?: only| or later)?", "gplv2"]),
    ("gpl-3-short", "gpl", ["(?:gnu )?gpl v?3(?: 0)?(?: only| or later)?", "gplv3"]),
    ("lgpl-2", "general public", ["gnu library general public license v(?:ersion )?2(?: 0)?"]),
    ("lgpl-2.1", "general public", ["gnu lesser general public license v(?:ersion )?2 1"]),
    ("lgpl-3", "general public", ["gnu lesser general public license v(?:ersion )?3(?: 0)?"]),
    ("lgpl-short", "lgpl", ["(?:gnu )?lgpl v?(?:2 1|2|3)(?: 0)?(?: only| or later)?"]),
    ("agpl-3", "general public", ["(?:gnu )?affero general public license v(?:ersion )?3(?: 0)?"]),
    ("agpl-short", "agpl", ["(?:gnu )?agpl v?3(?: 0)?(?: only| or later)?"]),
    ("gfdl", "free documentation", ["gnu free documentation license(?: version 1 [123])?"]),
    ("mpl-1", "mozilla", ["mozilla public license v(?:ersion )?1(?: [01])?"]),
    ("mpl-2", "mozilla", ["mozilla public license v(?:ersion )?2(?: 0)?"]),
    ("mpl-short", "mpl", ["mpl (?:1 0|1 1|2 0)"]),
    ("epl-1", "eclipse", ["eclipse public license v?(?:ersion )?1(?: 0)?"]),
    ("epl-2", "eclipse", ["eclipse public license v?(?:ersion )?2(?: 0)?"]),
    ("cddl", "common development", ["common development and distribution license(?: version 1 [01])?"]),
    ("cpl", "common public", ["common public license(?: version 1 0)?"]),
    ("artistic-1", "artistic", ["artistic license(?: version)? 1(?: 0)?"]),
    ("artistic-2", "artistic", ["artistic license(?: version)? 2(?: 0)?"]),
    ("isc", "isc", ["isc"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("boost", "boost", ["boost software license(?: version 1 0)?", "boost"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"]),
    ("wtfpl", "want to public", ["do what the fuck you want to public"]),
    ("wtfpl-short", "wtfpl", ["wtfpl"]),
    ("cc0", "cc0", ["cc0(?: 1 0)?"]),
    ("cc-by", "cc by", ["cc by(?: [1234] [05])?"]),
    ("cc-by-sa", "cc by", ["cc by sa(?: [1234] [05])?"]),
    ("cc-by-nd", "cc by", ["cc by nd(?: [1234] [05])?"]),
    ("cc-by-nc", "cc by", ["cc by nc(?: [1234] [05])?"]),
    ("cc-by-nc-sa", "cc by", ["cc by nc sa(?: [1234] [05])?"]),
    ("cc-by-nc-nd", "cc by", ["cc by nc nd(?: [1234] [05])?"]),
    ("cc-by", "creative commons", ["creative commons attribution(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-sa", "creative commons", ["creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nd", "creative commons", ["creative commons attribution no ?derivatives(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nc", "creative commons", ["creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nc-sa", "creative commons", ["creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?"]),
    ("odc-by", "open data", ["open data commons attribution license"]),
    ("odbl", "open data", ["open (?:data commons open )?database license"]),
    ("public-domain", "public domain", ["(?:released|placed|dedicated) (?:into|in|to) the public domain"]),
    ("proprietary", "all rights", ["all rights reserved"]),
    ("openssl", "openssl", ["openssl"]),
    ("php", "php", ["php license(?: version 3 01)?"]),
    ("python", "python", ["python software foundation license(?: version 2)?"]),
    ("python", "psf", ["psf license"]),
    ("ruby", "ruby", ["ruby"]),
    ("postgresql", "postgresql", ["postgresql"]),
    ("ofl", "open font", ["sil open font license(?: version 1 1)?"]),
    ("eupl", "european union", ["european union public licen[cs]e(?: v?(?:ersion )?1 [12])?"]),
    ("ms-pl", "microsoft", ["microsoft public license"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"]),
]

#: How a license is named in running text, each with priority (lower is better) and weight; {} is the name.
FORMS = [
    ("spdx license identifier {}", 0, 1.0),
    ("(?:re)?licensed under (?:the |a )?(?:terms of the )?{}(?: licen[cs]e)?", 1, 0.98),
    ("(?:released|distributed|published|available|offered) under (?:the |a )?(?:terms of the )?{}(?: licen[cs]e)?", 1, 0.97),
    ("under (?:the |a )?(?:terms of the )?{}(?: licen[cs]e)?", 2, 0.9),
    ("subject to (?:the |a )?(?:terms of the )?{}(?: licen[cs]e)?", 2, 0.9),
    ("the {} licen[cs]e", 3, 0.8),
    ("licen[cs]e {}", 3, 0.7),
]
#: Names long enough to count without any form around them.
PLAIN = ("public", "commons", "cc by", "version", "clause", "licen", "reserved", "gpl")


#: Sentences of license texts, file headers and notices as patterns over words: label, keyword, pattern.
SIGNATURES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "deal in", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("ncsa", "deal with", "to deal with the software without restriction including without limitation the rights to use"),
    ("x11", "used in advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("json", "used for good", "the software shall be used for good not evil"),
    ("unicode", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("boost", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("w3c", "hereby granted", "permission to copy modify and distribute this (?:software|work|document) (?:and its documentation )?with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", "patent rights", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("sleepycat", "redistributions in any", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("apache-1.1", "product includes software", "this product includes software developed by the apache (?:group|software foundation)"),
    ("openssl", "product includes software", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "product includes cryptographic", "this product includes cryptographic software written by eric young"),
    ("php", "product includes php", "this product includes php software freely available from"),
    ("apache-2", "applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "each contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated in this section patent) license"),
    ("apache-2", "terms and conditions", "terms and conditions for use reproduction and distribution"),
    ("gpl-2", "free software", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "free software", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "free software", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("lgpl-2", "free software", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "free software", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "free software", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "free software", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", "general public", "you should have received a copy of the gnu general public license"),
    ("lgpl", "general public", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "general public", "you should have received a copy of the gnu affero general public license"),
    ("gpl-2", "freedom to share", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "general public", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3", "general public", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v(?:ersion )?1 0"),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("cpl", "common public", "the accompanying program is provided under the terms of this common public license"),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "held liable", "in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "png reference", "the png reference library is supplied as is"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("cc0", "associated a work", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "neighboring rights", "has waived all copyright and related or neighboring rights"),
    ("creative-commons", "redistribute the material", "copy and redistribute the material in any medium or format"),
    ("creative-commons", "creative commons", "some rights reserved (?:under )?(?:a )?creative commons"),
    ("artistic-1", "intent of this", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "establishes the terms", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", "under the same terms as perl(?: 5)? itself"),
    ("ruby", "verbatim copies", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("python", "psf", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("ofl", "open font", "this font software is licensed under the sil open font license"),
    ("ofl", "open font", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ms-pl", "governs use", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("beerware", "retain this notice", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("vim", "charityware", "vim is charityware"),
    ("afl-3", "academic free", "academic free license v(?:ersion )?3 0"),
    ("osl-3", "open software", "open software license v(?:ersion )?3 0"),
    ("upl-1", "universal permissive", "universal permissive license v(?:ersion )?1 0"),
    ("blueoak-1", "blue oak", "blue oak model license(?: version)? 1 0 0"),
    ("mulan-2", "mulan", "mulan (?:psl v2|permissive software license(?: version 2| v2))"),
    ("qpl-1", "q public", "q public license(?: version 1 0)?"),
    ("busl-1.1", "business source", "business source license(?: version)? 1 1"),
    ("sspl-1", "server side", "server side public license(?: version 1)?"),
    ("elastic-2", "elastic license", "elastic license 2 0"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("cdla-permissive", "community data", "community data license agreement permissive"),
    ("cdla-sharing", "community data", "community data license agreement sharing"),
    ("openrail-m", "openrail", "(?:creativeml |bigscience )?openrail(?: m)? license"),
    ("llama", "community license", "llama [23] community license agreement"),
    ("proprietary", "reproduced", "no part of this (?:publication|book|work|document|report) may be reproduced"),
    ("proprietary", "reproduced", "may not be reproduced (?:or distributed )?without (?:the )?(?:prior )?written (?:permission|consent)"),
    ("proprietary", "strictly prohibited", "unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|software|work) is strictly prohibited"),
]

#: Identifiers as they stand in headers and addresses: label, keyword, identifier.
IDENTIFIERS = [
    ("mit", "mit", "mit"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"), ("boost", "bsl", "bsl 1 0"), ("apache-1.1", "apache", "apache 1 1"), ("apache-2", "apache", "apache 2 0"),
    ("bsd-2-clause", "bsd", "bsd 2 clause"), ("bsd-3-clause", "bsd", "bsd 3 clause"), ("gpl-2", "gpl", "gpl 2 0"), ("gpl-3", "gpl", "gpl 3 0"), ("lgpl-2.1", "lgpl", "lgpl 2 1"),
    ("lgpl-3", "lgpl", "lgpl 3 0"), ("agpl-3", "agpl", "agpl 3 0"), ("mpl-1", "mpl", "mpl 1 1"), ("mpl-2", "mpl", "mpl 2 0"), ("epl-1", "epl", "epl 1 0"), ("epl-2", "epl", "epl 2 0"),
    ("cddl", "cddl", "cddl 1 0"), ("artistic-2", "artistic", "artistic 2 0"), ("afl-3", "afl", "afl 3 0"), ("osl-3", "osl", "osl 3 0"), ("upl-1", "upl", "upl 1 0"), ("ncsa", "ncsa", "ncsa"),
    ("unlicense", "unlicense", "unlicense"), ("postgresql", "postgresql", "postgresql"), ("ofl", "ofl", "ofl 1 1"), ("eupl", "eupl", "eupl 1 [12]"), ("ms-pl", "ms pl", "ms pl"), ("0bsd", "0bsd", "0bsd"),
]
#: Where an identifier stands; all hold the word license.
ADDRESSES = ["spdx license identifier {}", "spdx org licenses {}", "opensource org licenses? {}(?: license)?", "licenses nuget org {} license", "gnu org licenses (?:old licenses )?{}", "choosealicense com licenses {}"]
#: Addresses of their own, as above.
PAGES = [
    ("apache-2", "apache", "apache org licenses license 2 0"),
    ("mpl-2", "mozilla", "mozilla org (?:en us )?mpl 2 0 license"),
    ("boost", "boost", "boost org license 1 0"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0 (?:legalcode )?license"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [234] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [234] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [234] [05]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [234] [05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [234] [05]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [234] [05]"),
]


def rules() -> list[Rule]:
    """All signature rules, in order: some hundreds."""
    out = []
    for label, keyword, names in FAMILIES:
        label = label.removesuffix("-short")
        for name in names:
            out += [Rule(label, form.format(f"(?:{name})"), keyword, p, w) for form, p, w in FORMS]
            if any(x in name for x in PLAIN):
                out.append(Rule(label, name, keyword, 4, 0.6))
    out += [Rule(label, pattern, keyword, 0, 0.95) for label, keyword, pattern in SIGNATURES]
    out += [Rule(label, form.format(name), keyword, 0, 1.0) for label, keyword, name in IDENTIFIERS for form in ADDRESSES]
    out += [Rule(label, pattern, keyword, 1, 0.97) for label, keyword, pattern in PAGES]
    return out


#: Keywords that are words of ordinary texts too: by themselves they don't open the gate.
COMMON = ("mit", "ruby", "boost", "isc", "python", "php")


def _gate(ruleset: list[Rule]) -> str:
    """A pattern that every text with a match of some rule has: licen[cs]e, a keyword, or a common one after the words that all other forms put before it. Keywords stand by first letter."""
    named = " (?:the |a )?(?:terms of the )?(?:" + "|".join(COMMON) + ")"
    addressed = {form.format(i) for _, _, i in IDENTIFIERS for form in ADDRESSES} | {x for _, _, x in PAGES}  # each holds the word license
    words = {r.keyword for r in ruleset if r.pattern not in addressed} - set(COMMON)
    first: dict[str, list[str]] = {}
    for word in ["licen[cs]e", "under" + named, "subject to" + named, *sorted(words)]:
        first.setdefault(word[0], []).append(word[1:])
    return "(?i) (?:" + "|".join(c + "(?:" + "|".join(rest) + ")" for c, rest in first.items()) + ")"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(low: Column, r: Column) -> Column:
    """Intervals of words where rule r stands in low, best order first: start, -end, priority, rule."""
    pattern = F.concat(F.lit("(?<= )(?:"), r.getField("pattern"), F.lit(")(?= )"))

    def intervals(found: Column) -> Column:
        gaps, hits = found.getField("gaps"), found.getField("hits")
        start = F.struct(F.lit(-1).alias("at"), F.array().cast(HITS).alias("out"))

        def step(a: Column, hit: Column) -> Column:
            k = F.size(a.getField("out"))
            begin = a.getField("at") + _spaces(F.get(gaps, k))
            span = _spaces(hit)
            one = F.struct(
                begin.alias("start"), (-(begin + span + 1)).alias("minus_end"), r.getField("priority").alias("priority"), r.getField("rule").alias("rule"),
                r.getField("label").alias("label"), r.getField("weight").alias("weight"),
            )
            return F.struct((begin + span).alias("at"), F.concat(a.getField("out"), F.array(one)).alias("out"))

        return F.aggregate(hits, start, step).getField("out")

    return let(F.struct(F.split(low, pattern, -1).alias("gaps"), F.regexp_extract_all(low, pattern, F.lit(0)).alias("hits")), intervals)


def _kept(found: Column) -> Column:
    """Detections not inside another: in order of start, longest first, each must end beyond all before it."""
    start = F.struct(F.lit(0).alias("end"), F.slice(found, 1, 0).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = -x.getField("minus_end")
        new = end > a.getField("end")
        return F.struct(F.greatest(a.getField("end"), end).alias("end"), F.when(new, F.concat(a.getField("out"), F.array(x))).otherwise(a.getField("out")).alias("out"))

    return F.aggregate(found, start, step).getField("out")


def scan(rows: DataFrame, text: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """rows with n_words, n_base, first_word, last_word, base_labels, detections (kept intervals with label and weight), labels and score."""
    ruleset = rules() if ruleset is None else ruleset
    listed = [{"pattern": r.pattern, "keyword": " " + r.keyword, "label": r.label, "priority": r.priority, "rule": k, "weight": r.weight} for k, r in enumerate(ruleset)]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<pattern:string,keyword:string,label:string,priority:int,rule:int,weight:double>>")  # folded to a constant
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score", "_low", "_norm", "_hits")
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    # The Kelvin sign and the dotted capital I lower-case to ASCII letters, which A-Z doesn't cover; any other letter will do.
    rows = rows.drop(*new)
    names = rows.columns
    norm = lambda n: F.struct(
        F.when(n == "  ", 0).otherwise(_spaces(n) - 1).cast("long").alias("n_words"),
        F.when(n.rlike(_gate(ruleset)), F.lower(F.regexp_replace(n, "[\u212aİ]", "å"))).alias("_low"),
    )
    rows = once(rows, F.concat(F.lit(" "), bare, F.lit(" ")), norm, "_norm").select(*names, "_norm.*")
    low = F.col("_low")
    pieces = lambda n: F.split(low, ANY_BASE, n)
    last_hit = F.element_at(F.regexp_extract_all(low, F.lit(ANY_BASE), F.lit(0)), -1)
    found = lambda low: F.flatten(F.transform(F.filter(table, lambda r: F.contains(low, r.getField("keyword"))), lambda r: _places(low, r)))
    hits = lambda low: F.struct(
        F.coalesce(F.regexp_count(low, F.lit(ANY_BASE)), F.lit(0)).cast("long").alias("n_base"),
        F.coalesce(F.when(low.isNotNull(), let(F.sort_array(found(low)), _kept)), F.lit(None).cast(HITS), F.array().cast(HITS)).alias("detections"),
        F.array_sort(F.filter(F.array(*(F.when(F.contains(low, F.lit(f" {p} ")), F.lit(v)) for p, v in BASE.items())), lambda x: x.isNotNull())).alias("base_labels"),
    )
    rows = once(rows, low, hits, "_hits").select(*names, "n_words", "_low", "_hits.*")
    some = F.col("n_base") > 0
    label = F.array_union(F.col("base_labels"), F.transform("detections", lambda d: d.getField("label")))
    rows = rows.withColumns(
        {
            "first_word": F.when(some, (_spaces(F.element_at(pieces(2), 1)) - 1).cast("long")),
            "last_word": F.when(some, (F.col("n_words") - (_spaces(F.element_at(pieces(-1), -1)) - 1) - (_spaces(last_hit) + 1)).cast("long")),
            "labels": F.array_join(F.array_sort(F.array_distinct(label)), ","),
            "base_labels": F.array_join(F.col("base_labels"), ","),
            "score": F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d.getField("weight"))), F.lit(0.0)), F.when(some, 0.9).otherwise(0.0)),
        }
    )
    return rows.drop("_low")
