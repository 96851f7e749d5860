"""License scan by ordered signature rules.

Rules are regular expressions over a text's normalised words (A-Z lower-cased, one space between words). Each rule has a
priority and keywords, one of which is in every match; a text that holds none of them isn't searched by that rule. Of
overlapping detections the one of better priority, then the longer, stands, and those inside it are suppressed.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import columns

# Fixed phrases and their labels.
BASE = [(b"gnu general public license", "gpl"), (b"apache license", "apache"), (b"cc by", "cc-by"), (b"mit license", "mit")]

# label, keyword (several with | between them), name as words, SPDX identifier as words
NAMES = [
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "gnu|gpl", r"(?:gnu general public licen[sc]e|(?:gnu )?gpl)(?: v| version|v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu|gpl", r"(?:gnu general public licen[sc]e|(?:gnu )?gpl)(?: v| version|v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser|lgpl", r"(?:gnu lesser general public licen[sc]e|(?:gnu )?lgpl)(?: v| version|v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser|lgpl", r"(?:gnu lesser general public licen[sc]e|(?:gnu )?lgpl)(?: v| version|v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e", "lgpl"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e(?: version 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:v|version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:licen[sc]e )?(?:v|version )?2(?: 0)?(?: licen[sc]e)?", "apache 2 0"),
    ("mit", "mit", r"mit licen[sc]e", "mit"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("x11", "x11", r"x11 licen[sc]e", "x11"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", "bsd 4 clause"),
    ("0bsd", "clause bsd|0bsd", r"(?:zero clause bsd|0bsd)(?: licen[sc]e)?", "0bsd"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", "bsd"),
    ("isc", "isc", r"isc licen[sc]e", "isc"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: v| version )1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?:(?: v| version )2 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: v| version )1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?:(?: v| version )2 0)?", "epl 2 0"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", "edl 1 0"),
    ("cddl-1.0", "development and distribution|cddl", r"(?:common development and distribution licen[sc]e|cddl)(?: 1 0)?", "cddl 1 [01]"),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl", "european", r"european union public licen[sc]e(?: v(?:ersion)? ?1 [012])?", "eupl 1 [012]"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: 2 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: 1 1)?", "busl 1 1"),
    ("sspl", "side", r"server side public licen[sc]e", "sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: 2 0)?", "elastic 2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng", r"libpng licen[sc]e", "libpng(?: 2 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("beerware", "beer", r"beer ?ware licen[sc]e", "beerware"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("php-3.01", "php", r"php licen[sc]e(?: version)?(?: 3 01?)?", "php 3 01?"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?", "psf 2 0"),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby"),
    ("ofl-1.1", "sil", r"sil open font licen[sc]e(?: version)?(?: 1 [01])?", "ofl 1 [01]"),
    ("osl-3.0", "open", r"open software licen[sc]e(?: v| version)?(?: ?3 0)?", "osl 3 0"),
    ("afl-3.0", "academic", r"academic free licen[sc]e(?: v| version)?(?: ?3 0)?", "afl 3 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "ms rl"),
    ("odbl", "database", r"open (?:data commons open )?database licen[sc]e", "odbl 1 0"),
    ("pddl", "dedication", r"(?:open data commons )?public domain dedication and licen[sc]e", "pddl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution licen[sc]e", "odc by 1 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?(?! (?:sa|nc|nd)\b)", "cc by [1234] [05]"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?(?! (?:sa|nd)\b)", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]"),
    ("cc-by", "creative", r"creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?(?! (?:share|non|no)\b)", "cc by"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by sa"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?", "cc by nd"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1234] [05])?(?! (?:share|no)\b)", "cc by nc"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", "cc by nc sa"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?", "cc by nc nd"),
    ("gpl", "gnu", r"gnu general public licen[sc]e", "gpl"),
    ("apache", "apache", r"apache licen[sc]e", "apache"),
]
# priority, share of trust, how a name is introduced
FRAMES = [
    (1, 0.99, r"spdx licen[sc]e identifier {id}"),
    (2, 0.95, r"(?:is |are )?(?:dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}"),
    (3, 0.9, r"(?:released|distributed|available|provided|published|redistribute it and or modify it) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"),
    (4, 0.85, r"(?:see|read|copy of|subject to) (?:the )?(?:terms of (?:the )?)?{name}"),
    (6, 0.7, r"{name}"),
]
# label, keyword, signature sentence
SENTENCES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so(?! subject)"),
    ("x11", "advertising", r"except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", r"the names? of .{1,80}? may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause-patent", "patent", r"bsd (?:2 clause )?plus patent licen[sc]e"),
    ("bsd-3-clause-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "conditions of any kind", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2.0", "asf", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "apache org", r"(?:https? )?www apache org licenses license 2 0"),
    ("gpl", "free", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "gnu", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl", "freedom", r"the licen[sc]es for most software are designed to take away your freedom to share and change it"),
    ("gpl", "gnu org", r"(?:https? )?www gnu org (?:copyleft|licenses) gpl"),
    ("gpl-2.0", "gnu", r"gnu general public licen[sc]e .{0,60}?either version 2 of the licen[sc]e"),
    ("gpl-3.0", "gnu", r"gnu general public licen[sc]e .{0,60}?either version 3 of the licen[sc]e"),
    ("gpl-2.0", "june 1991", r"(?:gnu )?general public licen[sc]e version 2 june 1991"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl-3.0", "29 june 2007", r"version 3 29 june 2007"),
    ("gpl-exception", "exception", r"(?:classpath|linking|gcc runtime library|autoconf|bison|font) exception"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", "library", r"gnu library general public licen[sc]e"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "gnu org", r"(?:https? )?www gnu org (?:copyleft|licenses) lgpl"),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-3.0", "remotely", r"all users interacting with it remotely through a computer network"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: v| version|v)? ?3(?: 0)?"),
    ("gfdl", "invariant", r"with no invariant sections(?: with)? no front cover texts and (?:with )?no back cover texts"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licen[sc]es"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "mozilla org", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-tri", "mpl", r"mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v(?:ersion)? ?)?2 0"),
    ("epl-2.0", "eclipse org", r"(?:https? )?www eclipse org legal epl (?:2 0|v20)"),
    ("epl-1.0", "eclipse org", r"(?:https? )?www eclipse org legal epl v10"),
    ("cddl-1.0", "cddl", r"use is subject to licen[sc]e terms .{0,120}?cddl"),
    ("cddl-1.0", "development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1.0", "cpl", r"cpl (?:v|version )?1 0"),
    ("eupl", "eupl", r"eupl (?:v|version )?1 [012]"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("zlib", "commercial applications", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", r"(?:https? )?(?:www )?unlicense org"),
    ("wtfpl", "do what the f", r"do what the f.{1,4} you want to(?: public licen[sc]e)?"),
    ("beerware", "beer in return", r"you can buy me a beer in return"),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[sc]e"),
    ("bsl-1.0", "machine executable", r"unless such copies or derivative works are solely in the form of machine executable object code"),
    ("bsl-1.0", "boost org", r"(?:https? )?www boost org license 1 0"),
    ("busl-1.1", "change date", r"(?:on|effective on) the change date"),
    ("busl-1.1", "production use", r"additional use grant .{0,120}?production use"),
    ("sspl", "service source code", r"you must make the service source code available"),
    ("sspl", "sspl", r"sspl(?: v| version|v)? ?1"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e condition)?(?: v?1 0)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|strict|shield|small business|perimeter|internal use) licen[sc]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("psf-2.0", "python", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e .{0,200}?python"),
    ("ruby", "ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl .{0,120}?ruby"),
    ("perl", "perl", r"(?:under )?the same terms as perl itself"),
    ("artistic-1.0", "artistic", r"either the gnu general public licen[sc]e or the artistic licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("tcl", "tcl", r"tcl tk licen[sc]e"),
    ("ofl-1.1", "font software", r"the font software may be sold as part of a larger software package"),
    ("ofl-1.1", "reserved font name", r"with reserved font names?"),
    ("ofl-1.1", "scripts sil org", r"(?:https? )?scripts sil org ofl"),
    ("ms-pl", "ms pl", r"(?:microsoft public licen[sc]e )?ms pl"),
    ("ms-limited", "microsoft", r"microsoft limited (?:public|reciprocal) licen[sc]e"),
    ("apple", "apple", r"apple public source licen[sc]e(?: version| ver)?(?: 2 0)?"),
    ("ibm", "ibm", r"ibm public licen[sc]e(?: version)?(?: 1 0)?"),
    ("sun", "sun", r"sun (?:public|industry standards source) licen[sc]e"),
    ("qpl", "q public", r"q public licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    ("unicode", "unicode", r"unicode (?:inc )?licen[sc]e agreement(?: data files and software)?"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[sc]e"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: free software)? licen[sc]e(?: agreement)?"),
    ("mulan", "mulan", r"mulan (?:permissive software licen[sc]e|psl)(?: v ?[12])?"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e(?: v?1 0)?"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e(?: v?[0-9])?"),
    ("anti-996", "996", r"anti 996 licen[sc]e"),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama [234](?: [0-9])? community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("odc-by", "attribution", r"odc attribution licen[sc]e"),
    ("odbl", "opendatacommons", r"(?:https? )?(?:www )?opendatacommons org licenses odbl"),
    ("pddl", "opendatacommons", r"(?:https? )?(?:www )?opendatacommons org licenses pddl"),
    ("cdla", "community data", r"community data licen[sc]e agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?"),
    ("ogl", "open government", r"open government licen[sc]e(?: v?[123] 0)?"),
    ("etalab", "etalab", r"(?:licence ouverte )?etalab(?: 2 0)?"),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "publicdomain", r"(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "publicdomain", r"(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nd", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by", "share", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
    ("public-domain", "copyright", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("public-domain", "government", r"(?:is a|are) works? of the (?:u s|us|united states) government"),
    ("proprietary", "rights", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) .{0,60}?(?:is )?strictly prohibited"),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|work|book|file) may be reproduced"),
    ("proprietary", "end user", r"end user licen[sc]e agreement"),
    ("proprietary", "trade secret", r"contains? (?:confidential information and |valuable )?trade secrets? of"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyright", "copyrighted", r"this (?:work|material|document) is copyrighted"),
    ("copyright", "reprinted", r"reprinted (?:by|with) permission(?: of)?"),
    ("notice", "see", r"see (?:the )?(?:file )?(?:licen[sc]e|copying)(?: txt| md)? (?:file )?(?:for|in the root)"),
    ("notice", "spdx", r"spdx licen[sc]e identifier"),
]


@functools.cache
def rules() -> list[tuple[int, float, str, tuple[bytes, ...], re.Pattern]]:
    """(priority, trust, label, keywords, pattern) in order of priority: every name in every frame, and the sentences."""
    out = [(5, 0.9, label, word, text) for label, word, text in SENTENCES]
    for label, word, name, ident in NAMES:
        for priority, trust, frame in FRAMES:
            by_id = "{id}" in frame
            out.append((priority, trust, label, "spdx" if by_id else word, frame.replace("{id}", ident).replace("{name}", name)))
    return [(p, t, label, tuple(w.encode().split(b"|")), re.compile(rf" (?:{x})(?= )".encode())) for p, t, label, w, x in sorted(out, key=lambda r: r[0])]


GATES = sorted({w for _, _, _, words, _ in rules() for w in words})


@functools.cache
def gate():
    """An automaton that finds all keywords in one pass; each brings the numbers of its rules."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in GATES:
        found.add_word(w.decode("latin-1"), tuple(i for i, r in enumerate(rules()) if w in r[3]))
    found.make_automaton()
    return found


_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def detect(norm: bytes, table) -> list[tuple[int, int, int, float, str]]:
    """(start, end, priority, trust, label) of the detections that stand, in a text of words with a space before each and
    at the end."""
    found = []
    for i in sorted({i for _, numbers in gate().iter(norm.decode("latin-1")) for i in numbers}):
        priority, trust, label, _, pattern = table[i]
        found += [(m.start(), m.end(), priority, trust, label) for m in pattern.finditer(norm)]
    return stand(found)


def stand(found: list) -> list:
    """Without detections that lie inside one of better priority or, at equal priority, inside a longer or earlier one.
    Intervals are swept from the left; those that can still hold another are kept at hand."""
    found.sort(key=lambda d: (d[0], -d[1], d[2]))
    out, open_ = [], []
    for d in found:
        open_ = [o for o in open_ if o[1] > d[0]]
        if not any(o[1] >= d[1] and o[2] <= d[2] for o in open_):
            out.append(d)
        open_.append(d)
    return out


def places(norm: bytes, phrase: bytes) -> list[int]:
    """Offsets of a phrase's places in a text of words."""
    out, p, at = [], b" " + phrase + b" ", -1
    while (at := norm.find(p, at + 1)) >= 0:
        out.append(at)
    return out


def _scan(batches):
    table = rules()
    for b in batches:
        data, off = columns(b.column("text"))
        raw = data.tobytes()
        rows = []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
            words = raw[i:j].translate(_TABLE).split(b" ")
            words = [w for w in words if w]
            norm = b" " + b" ".join(words) + b" " if words else b""
            found = [(at, label) for phrase, label in BASE for at in places(norm, phrase)]
            if found:  # a word's number is that of the spaces before it
                number = np.searchsorted(np.flatnonzero(np.frombuffer(norm, np.uint8) == 32), [at for at, _ in found]).tolist()
            hits = [(n, label) for n, (_, label) in zip(number if found else [], found)]
            base = {label for _, label in hits}
            more = detect(norm, table) if norm else []
            doubt = 1.0
            for trust in {d[4]: d[3] for d in sorted(more, key=lambda d: d[3])}.values():
                doubt *= 1 - trust
            score = 1 - doubt if more else (0.5 if base else 0.0)
            at = [h for h, _ in hits]
            rows.append((len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in more})), score))
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base (places of the fixed phrases), first_word, last_word (smallest and largest start of one, in
    words from 0; else null), base_labels, labels (with the rules' own; both distinct, sorted, comma-joined), score (0 to
    1: how far the detections can be trusted together): one row for each row of docs (doc_id, text; others are ignored).

    Null, empty and wordless texts: no words, empty labels, score 0. Empty table: no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, schema)
