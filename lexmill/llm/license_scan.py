"""Recognising licences by their sentences (operator 3), in DataFrame functions only.

A text is cut into sentences, each is normalised (A-Z lowered, everything but letters and digits made
one space) and looked up among known licence sentences. The identifiers, in the order of the text,
form a sequence in which an unknown sentence is a gap. Licence rules are sequences of identifiers
that must stand next to each other; they are tried in their order, longer and more special ones
first, and what a rule has matched is not offered to later rules. Everything happens within the row,
so nothing is shuffled. Only texts that hold a trigger word are cut; each known sentence has one, so no match
is lost. Lines that go on a sentence are joined, also behind comment marks; sentences that hold a colon or
semicolon are known by their parts; numbers of list items are no sentences.

Nulls and empty texts have no sentences and no licences; repeated rows each get their result; an
empty table gives an empty result; very long texts are cut whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, table

#: Sentences of public licence texts, as they read after normalisation.
SENTENCES = {
    "mit_title": ["mit license", "the mit license", "the mit license mit", "expat license"],
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "this software is released under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "no_liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc_title": ["isc license"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zero_bsd_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd_ref": ["licensed under the bsd license", "released under the bsd license", "use of this source code is governed by a bsd style license that can be found in the license file"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd_as_is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "apache_title": ["apache license"],
    "apache_ref": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache_comply": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at"],
    "apache_unless": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl2_ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl_free": ["this program is free software"],
    "gpl_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl2_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl2_only": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "gpl3_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3_terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_later": ["either version 2 of the license or at your option any later version"],
    "gpl3_later": ["either version 3 of the license or at your option any later version"],
    "gpl_warranty": ["this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "gpl_implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_see": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"],
    "gpl_copy": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl21_ref": ["licensed under the gnu lesser general public license version 2 1"],
    "lgpl3_ref": ["licensed under the gnu lesser general public license version 3"],
    "agpl3_ref": ["licensed under the gnu affero general public license version 3"],
    "lgpl_free": ["this library is free software"],
    "lgpl_terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl21_terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3_terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl21_later": ["either version 2 1 of the license or at your option any later version"],
    "mpl2_ref": ["this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2 0"],
    "mpl2_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "epl2_ref": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "boost_ref": ["distributed under the boost software license version 1 0"],
    "unlicense_free": ["this is free and unencumbered software released into the public domain"],
    "cc0_ref": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"],
    "cc_by_ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa_ref": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc_by_nc_ref": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by_nd_ref": ["licensed under cc by nd 4 0"],
    "cc_by_nc_sa_ref": ["licensed under cc by nc sa 4 0"],
}

#: Ordered rules: a licence and the identifiers that must follow each other.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is", "no_liability"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache_ref", "apache_comply", "apache_copy"]),
    ("GPL-2.0-or-later", ["gpl_terms", "gpl2_later"]),
    ("GPL-2.0-or-later", ["gpl2_terms"]),
    ("GPL-2.0-only", ["gpl2_only"]),
    ("GPL-3.0-or-later", ["gpl_terms", "gpl3_later"]),
    ("GPL-3.0-or-later", ["gpl3_terms"]),
    ("AGPL-3.0-or-later", ["agpl3_terms"]),
    ("LGPL-2.1-or-later", ["lgpl_terms", "lgpl21_later"]),
    ("LGPL-2.1-or-later", ["lgpl21_terms"]),
    ("LGPL-3.0-or-later", ["lgpl_terms", "gpl3_later"]),
    ("LGPL-3.0-or-later", ["lgpl3_terms"]),
    ("MPL-2.0", ["mpl2_ref", "mpl2_copy"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("0BSD", ["zero_bsd_grant"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_title"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_title"]),
    ("MIT", ["mit_ref"]),
    ("BSD", ["bsd_grant"]),
    ("BSD", ["bsd_ref"]),
    ("Apache-2.0", ["apache_ref"]),
    ("Apache", ["apache_title"]),
    ("GPL-2.0-only", ["gpl2_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    ("GPL", ["gpl_terms"]),
    ("LGPL", ["lgpl_terms"]),
    ("LGPL-2.1-only", ["lgpl21_ref"]),
    ("LGPL-3.0-only", ["lgpl3_ref"]),
    ("AGPL-3.0-only", ["agpl3_ref"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("EPL-2.0", ["epl2_ref"]),
    ("BSL-1.0", ["boost_ref"]),
    ("Unlicense", ["unlicense_free"]),
    ("CC0-1.0", ["cc0_ref"]),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa_ref"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_ref"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_ref"]),
    ("CC-BY-ND-4.0", ["cc_by_nd_ref"]),
    ("CC-BY-4.0", ["cc_by_ref"]),
]
#: Every known sentence has one of these.
TRIGGERS = ["licen", "copyright", "permission", "warrant", "domain", "redistribut", "software", "mozilla"]

BREAK = r"[.!?;:]+(\s+|$)|\n+"
#: A line that goes on with these is a part of the sentence before it; comment marks stand aside.
GOES_ON = r"\n[ \t]*[#*/]*[ \t]*([a-z(\"]|[A-Z][A-Z]|(?:License|Lesser|General|Public|Software|Foundation)[ .,;])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules=RULES, triggers=TRIGGERS) -> DataFrame:
    """Every row's doc_id with ``sentence_ids`` (array, in order), ``licences`` (array, in rule order) and ``n_sentences``."""
    for i, ss in sentences.items():
        if not all(any(t in s for t in triggers) for s in ss):
            raise ValueError(f"a sentence of {i} holds no trigger word")
    known = F.create_map(*[F.lit(x) for i, ss in sentences.items() for s in ss for x in (s, i)])
    d = docs.select("doc_id", empty_text().alias("_t"))
    hit = F.lit(False)
    for t in triggers:
        hit = hit | F.contains(F.col("_low"), F.lit(t))
    d = d.withColumn("_low", F.translate(F.when(F.col("_t").rlike("[Ll][Ii][Cc][Ee][Nn]|[Cc][Oo][Pp][Yy][Rr]|[Pp][Ee][Rr][Mm][Ii]|[Ww][Aa][Rr][Rr]|[Dd][Oo][Mm][Aa][Ii]|[Rr][Ee][Dd][Ii][Ss]|[Ss][Oo][Ff][Tt][Ww]|[Mm][Oo][Zz][Ii]"), F.col("_t")).otherwise(F.lit("")), UPPER, LOWER))
    # sentences end at marks and line ends
    joined = F.regexp_replace(F.col("_t"), GOES_ON, " $1")
    cut = F.when(hit, F.split(joined, BREAK)).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", cut.alias("_s"))
    plain = lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " "))
    d = d.withColumn("_s", F.filter(F.transform("_s", plain), lambda s: ~s.rlike("^([0-9]*|[a-z])$")))
    d = d.select("doc_id", F.size("_s").cast("long").alias("n_sentences"), F.transform("_s", lambda s: F.try_element_at(known, s)).alias("_i"))
    d = d.withColumn("sentence_ids", F.array_compact("_i"))
    marks = F.when(F.size("sentence_ids") > 0, F.array_join(F.transform("_i", lambda i: F.when(i.isNull(), ".").otherwise(F.concat(F.lit("<"), i, F.lit(">")))), "")).otherwise("")
    table_of_rules = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_pattern(ids)).alias("p")) for n, ids in rules])
    found = F.aggregate(
        table_of_rules,
        F.struct(marks.alias("m"), F.array().cast("array<string>").alias("f")),
        lambda a, r: F.when(F.contains(a["m"], r["p"]), F.struct(F.replace(a["m"], r["p"], F.lit(".")).alias("m"), F.concat(a["f"], F.array(r["n"])).alias("f"))).otherwise(a),
        lambda a: F.array_distinct(a["f"]),
    )
    none = F.array().cast("array<string>")
    return d.select("doc_id", "n_sentences", "sentence_ids", F.when(F.size("sentence_ids") > 0, found).otherwise(none).alias("licences"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def _sql() -> str:
    known = ",".join(f"'{s}': '{i}'" for i, ss in SENTENCES.items() for s in ss)
    steps, last = "", "k"
    for n, (name, ids) in enumerate(RULES):
        p = _pattern(ids)
        steps += f"\n, r{n} as (select doc_id,rid,i,case when contains(m,'{p}') and not list_contains(f,'{name}') then list_append(f,'{name}') else f end f,replace(m,'{p}','.') m from {last})"
        last = f"r{n}"
    gate = " or ".join(f"contains(translate(t,'{UPPER}','{LOWER}'),'{t}')" for t in TRIGGERS)
    return rf"""
with d as (select row_number() over () rid,doc_id,coalesce(text,'') t from documents)
, s as (select doc_id,rid,list_filter(list_transform(case when {gate} then regexp_split_to_array(regexp_replace(t,'{GOES_ON}',' \1','g'),'[.!?;:]+(?:\s+|$)|\n+') else []::varchar[] end,
   lambda x: trim(regexp_replace(translate(x,'{UPPER}','{LOWER}'),'[^a-z0-9]+',' ','g'))),lambda x: not regexp_full_match(x,'[0-9]*|[a-z]')) s from d)
, i as (select doc_id,rid,list_transform(s,lambda x: (map {{{known}}})[x]) i from s)
, k as (select doc_id,rid,i,array_to_string(list_transform(i,lambda x: case when x is null then '.' else '<'||x||'>' end),'') m,[]::varchar[] f from i){steps}
select doc_id,len(list_filter(i,lambda x: x is not null))::bigint n_known,coalesce(array_to_string(list_filter(i,lambda x: x is not null),','),'') sentence_ids,coalesce(array_to_string(f,','),'') licences from {last}"""


ORACLE = _sql()
