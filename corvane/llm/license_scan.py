"""Licence recognition by sentences and ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences: identifier, family, and phrases that a normalised sentence has, in this order, as whole words. Of one family the first that matches counts in a sentence.
SENTENCES = [
    ("spdx-apache-2.0", "spdx", ["spdx license identifier apache 2.0"]),
    ("spdx-mit", "spdx", ["spdx license identifier mit"]),
    ("spdx-bsd-3", "spdx", ["spdx license identifier bsd 3 clause"]),
    ("spdx-bsd-2", "spdx", ["spdx license identifier bsd 2 clause"]),
    ("spdx-isc", "spdx", ["spdx license identifier isc"]),
    ("spdx-agpl-3", "spdx", ["spdx license identifier agpl 3.0"]),
    ("spdx-lgpl-3", "spdx", ["spdx license identifier lgpl 3.0"]),
    ("spdx-lgpl-2.1", "spdx", ["spdx license identifier lgpl 2.1"]),
    ("spdx-gpl-3", "spdx", ["spdx license identifier gpl 3.0"]),
    ("spdx-gpl-2", "spdx", ["spdx license identifier gpl 2.0"]),
    ("spdx-mpl-2.0", "spdx", ["spdx license identifier mpl 2.0"]),
    ("mit-name", "mit", ["under the mit license"]),
    ("mit-name", "mit", ["under mit license"]),
    ("mit-name", "mit", ["under the terms of the mit license"]),
    ("mit-name", "mit", ["under the expat license"]),
    ("mit-grant", "mit-grant", ["permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    ("mit-notice", "mit-notice", ["the above copyright notice and this permission notice", "shall be included in all copies"]),
    ("as-is", "as-is", ["software is provided as is without warranty of any kind"]),
    ("no-liability", "no-liability", ["in no event shall", "be liable"]),
    ("bsd-grant", "bsd-grant", ["redistribution and use in source and binary forms with or without modification are permitted"]),
    ("bsd-source", "bsd-source", ["redistributions of source code must retain the", "copyright notice"]),
    ("bsd-binary", "bsd-binary", ["redistributions in binary form must reproduce the", "copyright notice"]),
    ("bsd-endorse", "bsd-endorse", ["neither the name", "may be used to endorse or promote"]),
    ("bsd-endorse", "bsd-endorse", ["neither the names", "may be used to endorse or promote"]),
    ("bsd-as-is", "bsd-as-is", ["this software is provided by", "as is and any express or implied warranties"]),
    ("isc-grant", "isc-grant", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("isc-grant", "isc-grant", ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"]),
    ("isc-as-is", "isc-as-is", ["the software is provided as is and the author disclaims all warranties"]),
    ("zlib-as-is", "zlib-as-is", ["this software is provided as is without any express or implied warranty"]),
    ("zlib-grant", "zlib-grant", ["permission is granted to anyone to use this software for any purpose"]),
    ("unlicense", "unlicense", ["this is free and unencumbered software released into the public domain"]),
    ("boost-grant", "boost-grant", ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software"]),
    ("apache-2.0-name", "apache", ["apache license version 2.0"]),
    ("apache-2.0-name", "apache", ["apache license 2.0"]),
    ("apache-2.0-name", "apache", ["apache license v2.0"]),
    ("apache-2.0-name", "apache", ["apache license version 2"]),
    ("apache-2.0-name", "apache", ["apache 2.0 license"]),
    ("apache-obtain", "apache-obtain", ["you may obtain a copy of the license at"]),
    ("apache-as-is", "apache-as-is", ["unless required by applicable law or agreed to in writing", "distributed under the license is distributed on an as is basis"]),
    ("gpl-copy", "gpl", ["you should have received a copy of the gnu", "public license"]),
    ("gpl-details", "gpl", ["see the gnu", "public license for more details"]),
    ("agpl-3-name", "gpl", ["gnu affero general public license", "version 3"]),
    ("lgpl-3-name", "gpl", ["gnu lesser general public license", "version 3"]),
    ("lgpl-2.1-name", "gpl", ["gnu lesser general public license", "version 2.1"]),
    ("lgpl-2-name", "gpl", ["gnu library general public license", "version 2"]),
    ("agpl-name", "gpl", ["gnu affero general public license"]),
    ("lgpl-name", "gpl", ["gnu lesser general public license"]),
    ("lgpl-name", "gpl", ["gnu library general public license"]),
    ("gpl-3-name", "gpl", ["gnu general public license", "version 3"]),
    ("gpl-3-name", "gpl", ["gnu general public license", "v3"]),
    ("gpl-3-name", "gpl", ["gnu gpl version 3"]),
    ("gpl-3-name", "gpl", ["under the gplv3"]),
    ("gpl-2-name", "gpl", ["gnu general public license", "version 2"]),
    ("gpl-2-name", "gpl", ["gnu general public license", "v2"]),
    ("gpl-2-name", "gpl", ["gnu gpl version 2"]),
    ("gpl-2-name", "gpl", ["under the gplv2"]),
    ("gpl-1-name", "gpl", ["gnu general public license", "version 1"]),
    ("gpl-name", "gpl", ["gnu general public license"]),
    ("gpl-name", "gpl", ["under the gnu gpl"]),
    ("gpl-warranty", "gpl-warranty", ["is distributed in the hope that it will be useful", "without any warranty"]),
    ("gfdl-1.3-name", "gfdl", ["gnu free documentation license", "version 1.3"]),
    ("gfdl-1.2-name", "gfdl", ["gnu free documentation license", "version 1.2"]),
    ("mpl-2.0-name", "mpl", ["mozilla public license version 2.0"]),
    ("mpl-2.0-name", "mpl", ["mozilla public license v 2.0"]),
    ("mpl-2.0-name", "mpl", ["mozilla public license 2.0"]),
    ("mpl-1.1-name", "mpl", ["mozilla public license version 1.1"]),
    ("epl-2.0-name", "epl", ["eclipse public license", "2.0"]),
    ("epl-1.0-name", "epl", ["eclipse public license", "1.0"]),
    ("artistic-name", "artistic", ["the artistic license"]),
    ("artistic-name", "artistic", ["the clarified artistic license"]),
    ("cc0-name", "cc", ["cc0"]),
    ("cc-by-nc-nd-4.0", "cc", ["cc by nc nd 4.0"]),
    ("cc-by-nc-nd-4.0", "cc", ["creative commons attribution noncommercial noderivatives 4.0"]),
    ("cc-by-nc-sa-4.0", "cc", ["cc by nc sa 4.0"]),
    ("cc-by-nc-sa-4.0", "cc", ["creative commons attribution noncommercial sharealike 4.0"]),
    ("cc-by-nc-4.0", "cc", ["cc by nc 4.0"]),
    ("cc-by-nc-4.0", "cc", ["creative commons attribution noncommercial 4.0"]),
    ("cc-by-sa-4.0", "cc", ["cc by sa 4.0"]),
    ("cc-by-sa-4.0", "cc", ["creative commons attribution sharealike 4.0"]),
    ("cc-by-4.0", "cc", ["cc by 4.0"]),
    ("cc-by-4.0", "cc", ["creative commons attribution 4.0"]),
    ("all-rights", "all-rights", ["all rights reserved"]),
]
#: Licence rules in order: the licence and the sequence of sentences that stands for it.
RULES = [
    ("MIT", "mit-grant mit-notice as-is no-liability"),
    ("MIT", "mit-grant mit-notice as-is"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is no-liability"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is no-liability"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is"),
    ("ISC", "isc-grant isc-as-is no-liability"),
    ("ISC", "isc-grant isc-as-is"),
    ("Zlib", "zlib-as-is zlib-grant"),
    ("Unlicense", "unlicense as-is no-liability"),
    ("Unlicense", "unlicense"),
    ("BSL-1.0", "boost-grant"),
    ("Apache-2.0", "apache-2.0-name apache-obtain apache-as-is"),
    ("Apache-2.0", "apache-2.0-name"),
    ("Apache-2.0", "spdx-apache-2.0"),
    ("MIT", "mit-name"),
    ("MIT", "spdx-mit"),
    ("BSD-3-Clause", "spdx-bsd-3"),
    ("BSD-2-Clause", "spdx-bsd-2"),
    ("ISC", "spdx-isc"),
    ("AGPL-3.0", "agpl-3-name gpl-warranty gpl-details gpl-copy"),
    ("LGPL-3.0", "lgpl-3-name gpl-warranty gpl-details gpl-copy"),
    ("LGPL-2.1", "lgpl-2.1-name gpl-warranty gpl-details gpl-copy"),
    ("LGPL-2.0", "lgpl-2-name gpl-warranty gpl-details gpl-copy"),
    ("GPL-3.0", "gpl-3-name gpl-warranty gpl-details gpl-copy"),
    ("GPL-2.0", "gpl-2-name gpl-warranty gpl-details gpl-copy"),
    ("GPL-1.0", "gpl-1-name gpl-warranty gpl-details gpl-copy"),
    ("AGPL-3.0", "agpl-3-name"),
    ("AGPL-3.0", "spdx-agpl-3"),
    ("LGPL-3.0", "lgpl-3-name"),
    ("LGPL-3.0", "spdx-lgpl-3"),
    ("LGPL-2.1", "lgpl-2.1-name"),
    ("LGPL-2.1", "spdx-lgpl-2.1"),
    ("LGPL-2.0", "lgpl-2-name"),
    ("GPL-3.0", "gpl-3-name"),
    ("GPL-3.0", "spdx-gpl-3"),
    ("GPL-2.0", "gpl-2-name"),
    ("GPL-2.0", "spdx-gpl-2"),
    ("GPL-1.0", "gpl-1-name"),
    ("AGPL", "agpl-name"),
    ("LGPL", "lgpl-name"),
    ("GPL", "gpl-name"),
    ("GFDL-1.3", "gfdl-1.3-name"),
    ("GFDL-1.2", "gfdl-1.2-name"),
    ("MPL-2.0", "mpl-2.0-name"),
    ("MPL-2.0", "spdx-mpl-2.0"),
    ("MPL-1.1", "mpl-1.1-name"),
    ("EPL-2.0", "epl-2.0-name"),
    ("EPL-1.0", "epl-1.0-name"),
    ("Artistic", "artistic-name"),
    ("CC0-1.0", "cc0-name"),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-4.0"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-4.0"),
    ("CC-BY-NC-4.0", "cc-by-nc-4.0"),
    ("CC-BY-SA-4.0", "cc-by-sa-4.0"),
    ("CC-BY-4.0", "cc-by-4.0"),
]
#: Every sentence above has one of these; sentences without any are no candidates.
TRIGGER = r"licen[cs]e|permission|software|liable|redistribut|endorse|gpl|cc0|cc[^a-z]|creative|reserved|obtain|law|useful|received"
_trigger, _blank, _ends = re.compile(TRIGGER), re.compile(r"\n(?:[^a-z0-9\n]*\n)+"), re.compile(r"[.!?]+[ \t\r\f\n]+")
_other, _abbreviated = re.compile(r"[^a-z0-9.+]+"), re.compile(r"\bv\.[ \n]+")
_known = [(name, family, [f" {p} " for p in phrases]) for name, family, phrases in SENTENCES]
_lower = {c: c + 32 for c in range(65, 91)}
_steps = [("".join(f"[{s}]" for s in sequence.split()), f"{{{licence}}}") for licence, sequence in RULES]


def _known_in(s: str) -> list[str]:
    """Identifiers that a normalised sentence, with a space at either end, stands for, in order of place: as many searches as there are phrases, each linear."""
    found: dict[str, tuple[int, int, str]] = {}
    for order, (name, family, phrases) in enumerate(_known):
        if family in found:
            continue
        first = at = s.find(phrases[0])
        for before, p in zip(phrases, phrases[1:]):
            if at < 0:
                break
            at = s.find(p, at + len(before) - 1)
        if at >= 0:
            found[family] = (first, order, name)
    return [name for _, _, name in sorted(found.values())]


def sentence_ids(text: str) -> list[str]:
    """Identifiers of the licence sentences of a text, in order.

    Paragraphs end at lines without letters and digits, sentences at . ! ? with white space after it, so lines are wrapped as they like. A sentence is lower-cased (A-Z), runs of anything
    but letters, digits, dot and plus become a space (comment marks go), and spaces and dots at its ends go.
    """
    folded = text.translate(_lower)
    if not _trigger.search(folded):
        return []
    out = []
    for paragraph in _blank.split(_abbreviated.sub("v ", folded)):
        if _trigger.search(paragraph):
            for s in _ends.split(paragraph):
                if _trigger.search(s):
                    out += _known_in(f" {_other.sub(' ', s).strip(' .')} ")
    return out


def licences(ids: list[str]) -> tuple[list[str], list[str]]:
    """(licences in order of place, sentences that no rule took): each rule in turn replaces every run of its sentences."""
    chain = "".join(f"[{x}]" for x in ids)
    for run, licence in _steps:
        chain = chain.replace(run, licence)
    return re.findall(r"\{([^}]*)\}", chain), re.findall(r"\[([^\]]*)\]", chain)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, sentence_ids, licenses and unmatched (each comma-joined), n_license_sentences.

    Null and empty texts have none. Repeated rows and null ids are returned as they are; texts are
    scanned whole; other columns are not carried. Texts are independent: one pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [sentence_ids(t) if t else [] for t in b.column(1).to_pylist()]
            found = [licences(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([",".join(x) for x in ids], pa.string()), pa.array([",".join(x) for x, _ in found], pa.string()), pa.array([",".join(x) for _, x in found], pa.string()), pa.array([len(x) for x in ids], pa.int64())], [id_col, "sentence_ids", "licenses", "unmatched", "n_license_sentences"])

    plain = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__t"))
    return plain.mapInArrow(run, f"`{id_col}` {plain.dtypes[0][1]}, sentence_ids string, licenses string, unmatched string, n_license_sentences long")


#: Written apart from the tables above: sentences by LIKE, rules as replacements in a text.
LICENSE_SQL = r"""
WITH known(ord, id, family, first, pattern) AS (SELECT row_number() OVER (), * FROM (VALUES
 ('spdx-apache-2.0', 'spdx', 'spdx license identifier apache 2.0', '%'), ('spdx-mit', 'spdx', 'spdx license identifier mit', '%'), ('spdx-bsd-3', 'spdx', 'spdx license identifier bsd 3 clause', '%'),
 ('spdx-bsd-2', 'spdx', 'spdx license identifier bsd 2 clause', '%'), ('spdx-isc', 'spdx', 'spdx license identifier isc', '%'), ('spdx-agpl-3', 'spdx', 'spdx license identifier agpl 3.0', '%'),
 ('spdx-lgpl-3', 'spdx', 'spdx license identifier lgpl 3.0', '%'), ('spdx-lgpl-2.1', 'spdx', 'spdx license identifier lgpl 2.1', '%'), ('spdx-gpl-3', 'spdx', 'spdx license identifier gpl 3.0', '%'),
 ('spdx-gpl-2', 'spdx', 'spdx license identifier gpl 2.0', '%'), ('spdx-mpl-2.0', 'spdx', 'spdx license identifier mpl 2.0', '%'),
 ('mit-name', 'mit', 'under the mit license', '%'), ('mit-name', 'mit', 'under mit license', '%'), ('mit-name', 'mit', 'under the terms of the mit license', '%'), ('mit-name', 'mit', 'under the expat license', '%'),
 ('mit-grant', 'mit-grant', 'permission is hereby granted free of charge to any person obtaining a copy of this software', '%'),
 ('mit-notice', 'mit-notice', 'the above copyright notice and this permission notice', '% shall be included in all copies %'),
 ('as-is', 'as-is', 'software is provided as is without warranty of any kind', '%'), ('no-liability', 'no-liability', 'in no event shall', '% be liable %'),
 ('bsd-grant', 'bsd-grant', 'redistribution and use in source and binary forms with or without modification are permitted', '%'),
 ('bsd-source', 'bsd-source', 'redistributions of source code must retain the', '% copyright notice %'), ('bsd-binary', 'bsd-binary', 'redistributions in binary form must reproduce the', '% copyright notice %'),
 ('bsd-endorse', 'bsd-endorse', 'neither the name', '% may be used to endorse or promote %'), ('bsd-endorse', 'bsd-endorse', 'neither the names', '% may be used to endorse or promote %'),
 ('bsd-as-is', 'bsd-as-is', 'this software is provided by', '% as is and any express or implied warranties %'),
 ('isc-grant', 'isc-grant', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', '%'),
 ('isc-grant', 'isc-grant', 'permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted', '%'),
 ('isc-as-is', 'isc-as-is', 'the software is provided as is and the author disclaims all warranties', '%'), ('zlib-as-is', 'zlib-as-is', 'this software is provided as is without any express or implied warranty', '%'),
 ('zlib-grant', 'zlib-grant', 'permission is granted to anyone to use this software for any purpose', '%'), ('unlicense', 'unlicense', 'this is free and unencumbered software released into the public domain', '%'),
 ('boost-grant', 'boost-grant', 'permission is hereby granted free of charge to any person or organization obtaining a copy of the software', '%'),
 ('apache-2.0-name', 'apache', 'apache license version 2.0', '%'), ('apache-2.0-name', 'apache', 'apache license 2.0', '%'), ('apache-2.0-name', 'apache', 'apache license v2.0', '%'),
 ('apache-2.0-name', 'apache', 'apache license version 2', '%'), ('apache-2.0-name', 'apache', 'apache 2.0 license', '%'),
 ('apache-obtain', 'apache-obtain', 'you may obtain a copy of the license at', '%'),
 ('apache-as-is', 'apache-as-is', 'unless required by applicable law or agreed to in writing', '% distributed under the license is distributed on an as is basis %'),
 ('gpl-copy', 'gpl', 'you should have received a copy of the gnu', '% public license %'), ('gpl-details', 'gpl', 'see the gnu', '% public license for more details %'),
 ('agpl-3-name', 'gpl', 'gnu affero general public license', '% version 3 %'), ('lgpl-3-name', 'gpl', 'gnu lesser general public license', '% version 3 %'), ('lgpl-2.1-name', 'gpl', 'gnu lesser general public license', '% version 2.1 %'),
 ('lgpl-2-name', 'gpl', 'gnu library general public license', '% version 2 %'), ('agpl-name', 'gpl', 'gnu affero general public license', '%'), ('lgpl-name', 'gpl', 'gnu lesser general public license', '%'),
 ('lgpl-name', 'gpl', 'gnu library general public license', '%'), ('gpl-3-name', 'gpl', 'gnu general public license', '% version 3 %'), ('gpl-3-name', 'gpl', 'gnu general public license', '% v3 %'),
 ('gpl-3-name', 'gpl', 'gnu gpl version 3', '%'), ('gpl-3-name', 'gpl', 'under the gplv3', '%'), ('gpl-2-name', 'gpl', 'gnu general public license', '% version 2 %'), ('gpl-2-name', 'gpl', 'gnu general public license', '% v2 %'),
 ('gpl-2-name', 'gpl', 'gnu gpl version 2', '%'), ('gpl-2-name', 'gpl', 'under the gplv2', '%'), ('gpl-1-name', 'gpl', 'gnu general public license', '% version 1 %'),
 ('gpl-name', 'gpl', 'gnu general public license', '%'), ('gpl-name', 'gpl', 'under the gnu gpl', '%'), ('gpl-warranty', 'gpl-warranty', 'is distributed in the hope that it will be useful', '% without any warranty %'),
 ('gfdl-1.3-name', 'gfdl', 'gnu free documentation license', '% version 1.3 %'), ('gfdl-1.2-name', 'gfdl', 'gnu free documentation license', '% version 1.2 %'),
 ('mpl-2.0-name', 'mpl', 'mozilla public license version 2.0', '%'), ('mpl-2.0-name', 'mpl', 'mozilla public license v 2.0', '%'), ('mpl-2.0-name', 'mpl', 'mozilla public license 2.0', '%'),
 ('mpl-1.1-name', 'mpl', 'mozilla public license version 1.1', '%'), ('epl-2.0-name', 'epl', 'eclipse public license', '% 2.0 %'), ('epl-1.0-name', 'epl', 'eclipse public license', '% 1.0 %'),
 ('artistic-name', 'artistic', 'the artistic license', '%'), ('artistic-name', 'artistic', 'the clarified artistic license', '%'), ('cc0-name', 'cc', 'cc0', '%'),
 ('cc-by-nc-nd-4.0', 'cc', 'cc by nc nd 4.0', '%'), ('cc-by-nc-nd-4.0', 'cc', 'creative commons attribution noncommercial noderivatives 4.0', '%'), ('cc-by-nc-sa-4.0', 'cc', 'cc by nc sa 4.0', '%'),
 ('cc-by-nc-sa-4.0', 'cc', 'creative commons attribution noncommercial sharealike 4.0', '%'), ('cc-by-nc-4.0', 'cc', 'cc by nc 4.0', '%'), ('cc-by-nc-4.0', 'cc', 'creative commons attribution noncommercial 4.0', '%'),
 ('cc-by-sa-4.0', 'cc', 'cc by sa 4.0', '%'), ('cc-by-sa-4.0', 'cc', 'creative commons attribution sharealike 4.0', '%'), ('cc-by-4.0', 'cc', 'cc by 4.0', '%'), ('cc-by-4.0', 'cc', 'creative commons attribution 4.0', '%'),
 ('all-rights', 'all-rights', 'all rights reserved', '%'))),
folded AS (SELECT doc_id, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\bv\.[ \n]+', 'v ', 'g') AS t FROM documents
           WHERE regexp_matches(text, '(?i)licen|permission|software|liable|redistribut|endorse|gpl|cc|creative|reserved|obtain|law|useful|received')),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n(?:[^a-z0-9\n]*\n)+')) AS p, generate_subscripts(regexp_split_to_array(t, '\n(?:[^a-z0-9\n]*\n)+'), 1) AS i FROM folded),
sentences AS (SELECT doc_id, i, unnest(regexp_split_to_array(p, '[.!?]+[ \t\r\f\n]+')) AS raw, generate_subscripts(regexp_split_to_array(p, '[.!?]+[ \t\r\f\n]+'), 1) AS j FROM parts),
plain AS (SELECT doc_id, i, j, ' ' || trim(regexp_replace(raw, '[^a-z0-9.+]+', ' ', 'g'), ' .') || ' ' AS s FROM sentences WHERE regexp_matches(raw, 'licen|permission|software|liable|redistribut|endorse|gpl|cc|creative|reserved|obtain|law|useful|received')),
matches AS (SELECT doc_id, i, j, strpos(s, ' ' || first || ' ') AS place, ord, id, family FROM plain JOIN known ON s LIKE '% ' || first || ' %' AND substr(s, strpos(s, ' ' || first || ' ') + length(first) + 1) LIKE pattern),
ids AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id, i, j, family ORDER BY ord) = 1),
chains AS (SELECT doc_id, string_agg(id, ',' ORDER BY i, j, place, ord) AS sentence_ids, count(*) AS n, string_agg('[' || id || ']', '' ORDER BY i, j, place, ord) AS chain FROM ids GROUP BY doc_id),
done AS (SELECT doc_id, sentence_ids, n, list_reduce([chain,
 '[mit-grant][mit-notice][as-is][no-liability]=MIT', '[mit-grant][mit-notice][as-is]=MIT', '[bsd-grant][bsd-source][bsd-binary][bsd-endorse][bsd-as-is][no-liability]=BSD-3-Clause', '[bsd-grant][bsd-source][bsd-binary][bsd-endorse][bsd-as-is]=BSD-3-Clause',
 '[bsd-grant][bsd-source][bsd-binary][bsd-as-is][no-liability]=BSD-2-Clause', '[bsd-grant][bsd-source][bsd-binary][bsd-as-is]=BSD-2-Clause', '[isc-grant][isc-as-is][no-liability]=ISC', '[isc-grant][isc-as-is]=ISC', '[zlib-as-is][zlib-grant]=Zlib',
 '[unlicense][as-is][no-liability]=Unlicense', '[unlicense]=Unlicense', '[boost-grant]=BSL-1.0', '[apache-2.0-name][apache-obtain][apache-as-is]=Apache-2.0', '[apache-2.0-name]=Apache-2.0', '[spdx-apache-2.0]=Apache-2.0', '[mit-name]=MIT', '[spdx-mit]=MIT',
 '[spdx-bsd-3]=BSD-3-Clause', '[spdx-bsd-2]=BSD-2-Clause', '[spdx-isc]=ISC', '[agpl-3-name][gpl-warranty][gpl-details][gpl-copy]=AGPL-3.0', '[lgpl-3-name][gpl-warranty][gpl-details][gpl-copy]=LGPL-3.0',
 '[lgpl-2.1-name][gpl-warranty][gpl-details][gpl-copy]=LGPL-2.1', '[lgpl-2-name][gpl-warranty][gpl-details][gpl-copy]=LGPL-2.0', '[gpl-3-name][gpl-warranty][gpl-details][gpl-copy]=GPL-3.0', '[gpl-2-name][gpl-warranty][gpl-details][gpl-copy]=GPL-2.0',
 '[gpl-1-name][gpl-warranty][gpl-details][gpl-copy]=GPL-1.0', '[agpl-3-name]=AGPL-3.0', '[spdx-agpl-3]=AGPL-3.0', '[lgpl-3-name]=LGPL-3.0', '[spdx-lgpl-3]=LGPL-3.0', '[lgpl-2.1-name]=LGPL-2.1', '[spdx-lgpl-2.1]=LGPL-2.1', '[lgpl-2-name]=LGPL-2.0',
 '[gpl-3-name]=GPL-3.0', '[spdx-gpl-3]=GPL-3.0', '[gpl-2-name]=GPL-2.0', '[spdx-gpl-2]=GPL-2.0', '[gpl-1-name]=GPL-1.0', '[agpl-name]=AGPL', '[lgpl-name]=LGPL', '[gpl-name]=GPL', '[gfdl-1.3-name]=GFDL-1.3', '[gfdl-1.2-name]=GFDL-1.2', '[mpl-2.0-name]=MPL-2.0',
 '[spdx-mpl-2.0]=MPL-2.0', '[mpl-1.1-name]=MPL-1.1', '[epl-2.0-name]=EPL-2.0', '[epl-1.0-name]=EPL-1.0', '[artistic-name]=Artistic', '[cc0-name]=CC0-1.0', '[cc-by-nc-nd-4.0]=CC-BY-NC-ND-4.0', '[cc-by-nc-sa-4.0]=CC-BY-NC-SA-4.0', '[cc-by-nc-4.0]=CC-BY-NC-4.0',
 '[cc-by-sa-4.0]=CC-BY-SA-4.0', '[cc-by-4.0]=CC-BY-4.0'], lambda c, r: replace(c, split_part(r, '=', 1), '{' || split_part(r, '=', 2) || '}')) AS chain FROM chains)
SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(regexp_extract_all(chain, '\{([^}]*)\}', 1), ','), '') AS licenses,
  coalesce(array_to_string(regexp_extract_all(chain, '\[([^\]]*)\]', 1), ','), '') AS unmatched, coalesce(n, 0) AS n_license_sentences
FROM documents d LEFT JOIN done USING (doc_id)
"""
