"""License scan by ordered signature rules.

Rules are regular expressions over a text's lower-cased words. A rule is only tried on a text that
holds its keyword. Where detections overlap, one whose words lie inside those of a detection of the
same or a better tier is suppressed. Built-in functions only, no shuffle: a row's detections live in
an array of that row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that the contract fixes, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Names of licenses in words (alternatives by |), label, versions known. {v} is filled with a version's words.
FAMILIES: list[tuple[str, str, tuple[str, ...]]] = [
    ("(?:gnu )?affero general public licen[cs]e|gnu agpl|agpl", "agpl", ("3.0", "1.0")),
    ("(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl", "lgpl", ("3.0", "2.1", "2.0")),
    ("(?:gnu )?general public licen[cs]e|gnu gpl|gpl", "gpl", ("3.0", "2.0", "1.0")),
    ("(?:gnu )?free documentation licen[cs]e|gfdl", "gfdl", ("1.3", "1.2", "1.1")),
    ("apache (?:software )?licen[cs]e", "apache", ("2.0", "1.1", "1.0")),
    ("mozilla public licen[cs]e|mpl", "mpl", ("2.0", "1.1", "1.0")),
    ("eclipse public licen[cs]e|epl", "epl", ("2.0", "1.0")),
    ("eclipse distribution licen[cs]e|edl", "edl", ("1.0",)),
    ("common development and distribution licen[cs]e|cddl", "cddl", ("1.1", "1.0")),
    ("common public licen[cs]e|cpl", "cpl", ("1.0",)),
    ("european union public licen[cs]e|eupl", "eupl", ("1.2", "1.1", "1.0")),
    ("artistic licen[cs]e", "artistic", ("2.0", "1.0")),
    ("academic free licen[cs]e|afl", "afl", ("3.0", "2.1", "2.0")),
    ("open software licen[cs]e|osl", "osl", ("3.0", "2.1", "2.0")),
    ("boost software licen[cs]e|bsl", "bsl", ("1.0",)),
    ("business source licen[cs]e|busl", "busl", ("1.1",)),
    ("server side public licen[cs]e|sspl", "sspl", ("1.0",)),
    ("open data commons open database licen[cs]e|odbl", "odbl", ("1.0",)),
    ("open data commons attribution licen[cs]e|odc by", "odc-by", ("1.0",)),
    ("sil open font licen[cs]e|ofl", "ofl", ("1.1", "1.0")),
    ("mit licen[cs]e|expat licen[cs]e|mit x11 licen[cs]e", "mit", ()),
    ("(?:new|revised|modified|3 clause|three clause) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?", "bsd-3-clause", ()),
    ("(?:simplified|2 clause|two clause) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?", "bsd-2-clause", ()),
    ("bsd licen[cs]e", "bsd", ()),
    ("isc licen[cs]e", "isc", ()),
    ("zlib licen[cs]e", "zlib", ()),
    ("microsoft public licen[cs]e", "ms-pl", ()),
    ("microsoft reciprocal licen[cs]e", "ms-rl", ()),
    ("python software foundation licen[cs]e|psf licen[cs]e", "psf", ("2.0",)),
    ("php licen[cs]e", "php", ("3.01", "3.0")),
    ("creative commons zero|cc0", "cc0", ("1.0",)),
    ("(?:creative commons )?attribution non ?commercial no ?deriv(?:ative|ative work)s?|cc by nc nd", "cc-by-nc-nd", ("4.0", "3.0", "2.5")),
    ("(?:creative commons )?attribution non ?commercial share ?alike|cc by nc sa", "cc-by-nc-sa", ("4.0", "3.0", "2.5")),
    ("(?:creative commons )?attribution non ?commercial|cc by nc", "cc-by-nc", ("4.0", "3.0", "2.5")),
    ("(?:creative commons )?attribution no ?deriv(?:ative|ative work)s?|cc by nd", "cc-by-nd", ("4.0", "3.0", "2.5")),
    ("(?:creative commons )?attribution share ?alike|cc by sa", "cc-by-sa", ("4.0", "3.0", "2.5")),
    ("creative commons attribution|cc by", "cc-by", ("4.0", "3.0", "2.5")),
]
#: Rules without a family: pattern, label, tier, weight, keyword.
OTHERS: list[tuple[str, str, int, float, str]] = [
    ("all rights reserved", "reserved", 2, 0.6, "reserved"),
    ("(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public-domain", 0, 1.0, "domain"),
    ("public domain", "public-domain", 2, 0.4, "domain"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0, 1.0, "hereby"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 0, 1.0, "permission"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 0, 1.0, "redistribution"),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0, 1.0, "unencumbered"),
    ("do what the fuck you want to public licen[cs]e", "wtfpl", 0, 1.0, "want"),
    ("copyright (?:c )?[0-9]{4}(?: [0-9]{4})*", "copyright", 2, 0.3, "copyright"),
    ("proprietary and confidential", "proprietary", 1, 0.8, "proprietary"),
    ("no part of this (?:publication|book|work) may be reproduced", "reserved", 1, 0.8, "reproduced"),
]
#: Hand-written rules: pattern, label, tier, weight, keyword. A grant, a notice or a passage of a license's body is tier 0, a
#: name with its version tier 1, a mere name or hint tier 2.
WRITTEN: list[tuple[str, str, int, float, str]] = [
    # short forms, as one word or with their version behind
    ("gplv3(?: or later| only)?|gpl3", "gpl-3.0", 1, 0.9, "gplv3|gpl3"),
    ("gplv2(?: or later| only)?|gpl2", "gpl-2.0", 1, 0.9, "gplv2|gpl2"),
    ("gplv1|gpl1", "gpl-1.0", 1, 0.8, "gplv1|gpl1"),
    ("lgplv3(?: or later| only)?|lgpl3", "lgpl-3.0", 1, 0.9, "lgplv3|lgpl3"),
    ("lgplv2 1(?: or later| only)?", "lgpl-2.1", 1, 0.9, "lgplv2"),
    ("lgplv2(?! 1)(?: 0)?|lgpl2", "lgpl-2.0", 1, 0.8, "lgplv2|lgpl2"),
    ("agplv3(?: or later| only)?|agpl3", "agpl-3.0", 1, 0.9, "agplv3|agpl3"),
    ("agplv1|agpl1", "agpl-1.0", 1, 0.8, "agplv1|agpl1"),
    ("mplv2(?: 0)?", "mpl-2.0", 1, 0.9, "mplv2"),
    ("mplv1 1", "mpl-1.1", 1, 0.9, "mplv1"),
    ("eplv2(?: 0)?", "epl-2.0", 1, 0.9, "eplv2"),
    ("eplv1(?: 0)?", "epl-1.0", 1, 0.9, "eplv1"),
    ("(?:the )?asl 2(?: 0)? licen[cs]e|apache ?2(?: 0)? licen[cs]e(?:d)?", "apache-2.0", 1, 0.8, "license|licence|licensed|licenced"),
    ("apache 2(?: 0)?", "apache-2.0", 1, 0.6, "apache"),
    ("under the apache licen[cs]e", "apache", 1, 0.7, "apache"),
    ("mit licen[cs]ed", "mit", 0, 0.9, "mit"),
    ("(?:under|is) (?:the )?mit(?: x11)? licen[cs]e", "mit", 0, 0.9, "mit"),
    ("bsd licen[cs]ed", "bsd", 0, 0.8, "bsd"),
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit", "mit", 0, 0.9, "mit"),
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?bsd", "bsd", 1, 0.8, "bsd"),
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?isc", "isc", 0, 0.9, "isc"),
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?zlib", "zlib", 0, 0.9, "zlib"),
    ("bsd style licen[cs]e", "bsd", 1, 0.7, "bsd"),
    ("bsd 4 clause|4 clause bsd|original bsd licen[cs]e", "bsd-4-clause", 1, 0.9, "bsd"),
    ("0bsd|bsd zero clause|zero clause bsd", "0bsd", 1, 0.9, "0bsd|bsd"),
    ("cc by sa 2 0", "cc-by-sa-2.0", 1, 0.9, "cc"),
    ("cc by 2 0", "cc-by-2.0", 1, 0.9, "cc"),
    ("cc by nc nd 3 0 igo|cc by 3 0 igo", "cc-by-igo-3.0", 1, 0.9, "igo"),
    # headers of the copyleft family
    ("free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation", "gpl", 0, 1.0, "redistribute"),
    ("gnu general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)? or (?:at your option )?any later version", "gpl-3.0-or-later", 0, 1.0, "published"),
    ("gnu general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)? or (?:at your option )?any later version", "gpl-2.0-or-later", 0, 1.0, "published"),
    ("gnu general public licen[cs]e as published by the free software foundation version 2(?: of the licen[cs]e)?", "gpl-2.0", 0, 1.0, "published"),
    ("gnu general public licen[cs]e as published by the free software foundation version 3(?: of the licen[cs]e)?", "gpl-3.0", 0, 1.0, "published"),
    ("gnu lesser general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?", "lgpl-3.0-or-later", 0, 1.0, "lesser"),
    ("gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1(?: of the licen[cs]e)?", "lgpl-2.1-or-later", 0, 1.0, "lesser"),
    ("gnu library general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)?", "lgpl-2.0-or-later", 0, 1.0, "library"),
    ("gnu affero general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?", "agpl-3.0-or-later", 0, 1.0, "affero"),
    ("either version 2 of the licen[cs]e or (?:at your option )?any later version", "or-later-2", 1, 0.7, "version"),
    ("either version 3 of the licen[cs]e or (?:at your option )?any later version", "or-later-3", 1, 0.7, "version"),
    ("either version 2 1 of the licen[cs]e or (?:at your option )?any later version", "or-later-2.1", 1, 0.7, "version"),
    ("you should have received a copy of the gnu general public licen[cs]e along with", "gpl", 0, 0.9, "received"),
    ("you should have received a copy of the gnu lesser general public licen[cs]e along with", "lgpl", 0, 0.9, "received"),
    ("you should have received a copy of the gnu affero general public licen[cs]e along with", "agpl", 0, 0.9, "received"),
    ("see the gnu general public licen[cs]e for more details", "gpl", 0, 0.8, "details"),
    ("see the gnu lesser general public licen[cs]e for more details", "lgpl", 0, 0.8, "details"),
    ("see the gnu affero general public licen[cs]e for more details", "agpl", 0, 0.8, "details"),
    ("everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", "gnu-text", 0, 0.9, "verbatim"),
    ("the licen[cs]es for most software are designed to take away your freedom to share and change it", "gpl-2.0", 0, 1.0, "freedom"),
    ("the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", "gpl-3.0", 0, 1.0, "copyleft"),
    ("the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", "agpl-3.0", 0, 1.0, "copyleft"),
    ("this lesser general public licen[cs]e applies to some specially designated software packages", "lgpl-2.1", 0, 1.0, "designated"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 3", "gfdl-1.3", 0, 1.0, "documentation"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 2", "gfdl-1.2", 0, 1.0, "documentation"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 1", "gfdl-1.1", 0, 1.0, "documentation"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 [0-9]", "gfdl", 0, 1.0, "documentation"),
    ("with no invariant sections no front cover texts and no back cover texts|with no invariant sections with no front cover texts and with no back cover texts", "gfdl-no-invariants", 0, 0.8, "invariant"),
    ("gpl (?:2 0 )?with classpath exception|classpath exception", "gpl-classpath-exception", 1, 0.8, "classpath"),
    ("linking this library statically or dynamically with other modules is making a combined work", "gpl-linking-exception", 0, 0.9, "statically"),
    ("as a special exception the copyright holders", "exception", 1, 0.6, "exception"),
    ("gcc runtime library exception", "gcc-exception", 1, 0.9, "runtime"),
    ("dual licen[cs]ed under (?:the )?mit and (?:the )?gpl|mit gpl dual licen[cs]ed?", "mit-or-gpl", 0, 0.9, "dual"),
    ("dual licen[cs]ed under (?:the )?(?:mit and apache|apache and mit)|mit or apache 2 0|apache 2 0 or mit|mit apache 2 0", "mit-or-apache-2.0", 0, 0.9, "apache"),
    ("dual licen[cs]ed", "dual", 2, 0.4, "dual"),
    ("tri licen[cs]ed|mpl gpl lgpl tri licen[cs]e", "mpl-tri", 1, 0.7, "tri"),
    ("alternatively the contents of this file may be used under the terms of (?:either )?(?:of )?the gnu", "mpl-tri", 0, 0.9, "alternatively"),
    ("commercial licen[cs]es? (?:is|are) available", "commercial", 1, 0.6, "commercial"),
    # permissive bodies
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software", "mit", 0, 1.0, "sublicense|sublicence"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 0, 1.0, "substantial"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit", 0, 0.9, "noninfringement"),
    ("except as contained in this notice the names? of the (?:x consortium|above copyright holders|authors) shall not be used in advertising", "x11", 0, 0.9, "advertising"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose", "hpnd", 0, 0.9, "documentation"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 0, 1.0, "fee"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software", "isc", 0, 0.9, "disclaims"),
    ("redistributions of source code must retain the above copyright notice", "bsd", 0, 0.9, "redistributions"),
    ("redistributions in binary form must reproduce the above copyright notice", "bsd", 0, 0.9, "redistributions"),
    ("neither the name of (?:the )?(?:[a-z0-9]+ ){1,8}nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause", 0, 1.0, "endorse"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "bsd-4-clause", 0, 1.0, "advertising"),
    ("this software is provided by (?:the )?(?:[a-z0-9]+ ){1,8}as is and any express(?:ed)? or implied warranties", "bsd", 0, 0.8, "warranties"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "zlib", 0, 1.0, "liable"),
    ("the origin of this software must not be misrepresented", "zlib", 0, 0.9, "misrepresented"),
    ("altered source versions must be plainly marked as such", "zlib", 0, 0.9, "plainly"),
    ("licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e", "apache-2.0", 0, 1.0, "apache"),
    ("you may obtain a copy of the licen[cs]e at http (?:www )?apache org licen[cs]es licen[cs]e 2 0", "apache-2.0", 0, 1.0, "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "apache-2.0", 0, 0.9, "applicable"),
    ("licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "apache-2.0", 0, 1.0, "contributor"),
    ("this product includes software developed by the apache (?:software foundation|group)", "apache-1.1", 0, 0.8, "apache"),
    ("this product includes software developed by the openssl project", "openssl", 0, 1.0, "openssl"),
    ("boost software licen[cs]e version 1 0", "bsl-1.0", 0, 1.0, "boost"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1.0", 0, 1.0, "organization"),
    ("distributed under the boost software licen[cs]e", "bsl-1.0", 0, 0.9, "boost"),
    ("you can do whatever you want with this stuff if we meet some day", "beerware", 0, 1.0, "stuff"),
    ("beer ?ware licen[cs]e|the beer ware licen[cs]e", "beerware", 1, 0.9, "license|licence"),
    ("the author or authors of this code dedicate any and all copyright interest in this code to the public domain|we make this dedication for the benefit of the public at large", "unlicense", 0, 1.0, "domain|dedication"),
    ("anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 0, 1.0, "compile"),
    ("the author disclaims copyright to this source code", "blessing", 0, 1.0, "disclaims"),
    ("to the extent possible under law (?:[a-z0-9]+ ){1,10}has waived all copyright and related or neighbou?ring rights", "cc0-1.0", 0, 1.0, "waived"),
    ("cc0 1 0 universal", "cc0-1.0", 0, 1.0, "universal"),
    ("no rights reserved", "cc0", 1, 0.6, "reserved"),
    ("permission is hereby granted without written agreement and without licen[cs]e or royalty fees", "mit-modern", 0, 0.9, "royalty"),
    ("curl licen[cs]e|copyright and permission notice copyright (?:c )?[0-9 ]+daniel", "curl", 1, 0.8, "license|licence|permission"),
    ("universal permissive licen[cs]e", "upl-1.0", 1, 0.9, "permissive"),
    ("the unicode(?: data files and software)? licen[cs]e|unicode licen[cs]e agreement", "unicode", 1, 0.9, "unicode"),
    ("icu licen[cs]e", "icu", 1, 0.9, "icu"),
    ("ncsa open source licen[cs]e|university of illinois ncsa", "ncsa", 1, 0.9, "ncsa"),
    ("w3c software (?:notice and licen[cs]e|licen[cs]e)", "w3c", 1, 0.9, "w3c"),
    ("zope public licen[cs]e", "zpl", 1, 0.9, "zope"),
    ("postgresql licen[cs]e", "postgresql", 1, 0.9, "postgresql"),
    ("ruby licen[cs]e", "ruby", 1, 0.8, "ruby"),
    ("vim licen[cs]e", "vim", 1, 0.8, "vim"),
    ("tcl tk licen[cs]e", "tcl", 1, 0.8, "tcl"),
    ("openssl licen[cs]e", "openssl", 1, 0.9, "openssl"),
    ("artistic licen[cs]e 2 0", "artistic-2.0", 1, 0.9, "artistic"),
    ("same terms as perl(?: itself)?", "perl", 0, 0.9, "perl"),
    ("the freetype (?:project )?licen[cs]e", "ftl", 1, 0.9, "freetype"),
    ("independent jpeg group", "ijg", 1, 0.8, "jpeg"),
    ("libpng licen[cs]e", "libpng", 1, 0.9, "libpng"),
    ("mulan (?:psl|permissive software licen[cs]e)", "mulanpsl", 1, 0.9, "mulan"),
    # weak copyleft bodies
    ("this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "mpl-2.0", 0, 1.0, "mozilla"),
    ("the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mpl-1.1", 0, 1.0, "mozilla"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0", 0, 1.0, "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0", "epl-1.0", 0, 1.0, "accompanying"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?2 0", "epl-2.0", 0, 1.0, "accompanying"),
    ("the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "cddl", 0, 1.0, "development"),
    ("licen[cs]ed under the eupl", "eupl", 0, 1.0, "eupl"),
    ("microsoft public licen[cs]e ms pl|ms pl", "ms-pl", 1, 0.9, "ms"),
    ("licen[cs]ed under the open software licen[cs]e", "osl", 0, 0.9, "open"),
    ("reciprocal public licen[cs]e", "rpl", 1, 0.9, "reciprocal"),
    ("sleepycat licen[cs]e|the sleepycat public licen[cs]e", "sleepycat", 1, 0.9, "sleepycat"),
    ("q public licen[cs]e|qpl licen[cs]e", "qpl", 1, 0.9, "license|licence"),
    ("ibm public licen[cs]e", "ipl", 1, 0.9, "ibm"),
    ("sun (?:public|industry standards source) licen[cs]e", "spl", 1, 0.9, "sun"),
    ("netscape public licen[cs]e", "npl", 1, 0.9, "netscape"),
    ("apple public source licen[cs]e", "apsl", 1, 0.9, "apple"),
    ("nasa open source agreement", "nasa", 1, 0.9, "nasa"),
    ("lucent public licen[cs]e", "lpl", 1, 0.9, "lucent"),
    ("cecill(?: b| c)?(?: licen[cs]e)?", "cecill", 1, 0.8, "cecill"),
    # content and data
    ("this work is licen[cs]ed under (?:a |the )?creative commons attribution international licen[cs]e", "cc-by", 0, 1.0, "commons"),
    ("this work is licen[cs]ed under (?:a |the )?creative commons attribution share ?alike(?! [0-9])", "cc-by-sa", 0, 1.0, "commons"),
    ("this work is licen[cs]ed under (?:a |the )?creative commons attribution non ?commercial(?! (?:[0-9]|share|no))", "cc-by-nc", 0, 1.0, "commons"),
    ("some rights reserved", "cc", 2, 0.5, "reserved"),
    ("text is available under the creative commons attribution share ?alike licen[cs]e", "cc-by-sa", 0, 1.0, "commons"),
    ("creative commons org licen[cs]es by sa [0-9] [0-9]|creativecommons org licen[cs]es by sa [0-9] [0-9]", "cc-by-sa", 0, 0.9, "org"),
    ("creativecommons org licen[cs]es by nc [0-9] [0-9]", "cc-by-nc", 0, 0.9, "creativecommons"),
    ("creativecommons org licen[cs]es by nd [0-9] [0-9]", "cc-by-nd", 0, 0.9, "creativecommons"),
    ("creativecommons org licen[cs]es by [0-9] [0-9]", "cc-by", 0, 0.9, "creativecommons"),
    ("creativecommons org publicdomain zero 1 0", "cc0-1.0", 0, 1.0, "creativecommons"),
    ("creativecommons org publicdomain mark 1 0|public domain mark", "public-domain", 0, 0.9, "creativecommons|domain"),
    ("creative commons licen[cs]e", "cc", 2, 0.5, "commons"),
    ("open government licen[cs]e", "ogl", 1, 0.9, "government"),
    ("open database licen[cs]e", "odbl", 1, 0.9, "database"),
    ("public domain dedication and licen[cs]e|pddl", "pddl", 1, 0.9, "dedication|pddl"),
    ("community data licen[cs]e agreement", "cdla", 1, 0.9, "community"),
    ("this font software is licen[cs]ed under the sil open font licen[cs]e", "ofl", 0, 1.0, "font"),
    ("project gutenberg licen[cs]e", "gutenberg", 1, 0.9, "gutenberg"),
    ("free art licen[cs]e", "free-art", 1, 0.9, "art"),
    ("gnu simpler free documentation licen[cs]e", "gsfdl", 1, 0.9, "documentation"),
    # source-available and models
    ("business source licen[cs]e 1 1|business source licen[cs]e", "busl", 1, 0.9, "business"),
    ("elastic licen[cs]e 2 0|elastic licen[cs]e", "elastic", 1, 0.9, "elastic"),
    ("commons clause licen[cs]e condition", "commons-clause", 1, 0.9, "clause"),
    ("functional source licen[cs]e", "fsl", 1, 0.9, "functional"),
    ("polyform (?:noncommercial|strict|shield|small business) licen[cs]e", "polyform", 1, 0.9, "polyform"),
    ("prosperity public licen[cs]e", "prosperity", 1, 0.9, "prosperity"),
    ("responsible ai licen[cs]e|openrail(?: m)? licen[cs]e", "openrail", 1, 0.9, "license|licence"),
    ("for non ?commercial use only|non ?commercial use only", "non-commercial", 1, 0.6, "commercial|noncommercial"),
    ("for (?:academic|research|educational) (?:use|purposes) only(?: licen[cs]e)?", "research-only", 1, 0.6, "only"),
    ("end user licen[cs]e agreement", "eula", 1, 0.8, "agreement"),
    ("shareware licen[cs]e", "shareware", 1, 0.6, "shareware"),
    ("freeware licen[cs]e", "freeware", 1, 0.6, "freeware"),
    # rights and notices
    ("all rights are reserved", "reserved", 1, 0.7, "reserved"),
    ("rights reserved worldwide", "reserved", 1, 0.6, "reserved"),
    ("unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this (?:file|material) )?(?:via any medium )?is strictly prohibited", "proprietary", 0, 0.9, "prohibited"),
    ("reproduced (?:with|by) (?:the )?(?:kind )?permission of", "by-permission", 1, 0.6, "permission"),
    ("used (?:with|by) permission", "by-permission", 1, 0.5, "permission"),
    ("reprinted (?:with|by) permission", "by-permission", 1, 0.6, "permission"),
    ("crown copyright", "crown", 1, 0.8, "copyright"),
    ("this work is in the public domain|is in the public domain", "public-domain", 0, 0.9, "domain"),
    ("c (?:19|20)[0-9]{2} (?:[a-z0-9]+ ){1,6}all rights reserved", "reserved", 1, 0.7, "reserved"),
]


@dataclass(frozen=True)
class Rule:
    """pattern stands between spaces. Tier 0: a grant; 1: a name with a version; 2: a name."""

    pattern: str
    label: str
    tier: int
    weight: float
    keywords: tuple[str, ...]


def _keywords(alternatives: str) -> tuple[str, ...]:
    """For each alternative the longest word of plain letters that it always holds."""
    import re

    out = {}
    for alt in re.sub(r"\(\?:[^()]*\)\??", " ? ", alternatives).split("|"):
        words = [w for w in alt.split(" ") if re.fullmatch("[a-z0-9]+", w)]
        out[max(words, key=len)] = None
    return tuple(out)


#: What may follow a version, as the label says it and in words; licenses whose versions are given so.
SUFFIXES = (("", ""), ("-or-later", " or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?"), ("-only", " only"))
SUFFIXED = ("agpl", "lgpl", "gpl", "gfdl")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order, best first: those written out, and those made from FAMILIES by a few ways of naming a license."""
    # a license's own address comes before the written rule for any version of it
    out = [Rule(f"creative ?commons org licen[cs]es {label[3:].replace('-', ' ')} {v.replace('.', ' ')}", f"{label}-{v}", 0, 0.9, ("org",)) for _, label, versions in FAMILIES for v in versions if label.startswith("cc-by")]
    out += [Rule(*x, tuple(key.split("|"))) for *x, key in WRITTEN]
    grant = "(?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the |a )?(?:terms of (?:the |a )?)?"
    for names, label, versions in FAMILIES:
        key, name, spdx = _keywords(names), f"(?:{names})", f"spdx license identifier {label.replace('-', ' ')}"
        for v in versions:
            words = v.replace(".", " ")
            short = v.removesuffix(".0")
            number = f"(?:version |v ?)?(?:{words}|{short})" if short != v else f"(?:version |v ?)?{words}"
            for suffix, said in SUFFIXES if label in SUFFIXED else SUFFIXES[:1]:
                full = f"{label}-{v}{suffix}"
                out.append(Rule(f"{grant}{name} {number}{said}", full, 0, 1.0, key))
                out.append(Rule(f"{spdx} {words}{said}", full, 0, 1.0, ("spdx",)))
                out.append(Rule(f"{name} {number}{said}", full, 1, 0.9, key))
        out.append(Rule(f"{grant}{name}", label, 1, 0.8, key))
        out.append(Rule(spdx, label, 1, 0.9, ("spdx",)))
        out.append(Rule(name, label, 2, 0.5, key))
    out += [Rule(*x, (key,)) for *x, key in OTHERS]
    return tuple(sorted(out, key=lambda r: r.tier))


#: A text without any of these, in any case, has no detection and no base phrase.
GATE = (
    "licen", "reserved", "domain", "hereby", "permission", "redistribut", "unencumbered", "copyright", "proprietary", "reproduced", "attribution", "creative",
    "misrepresented", "plainly", "endorse", "advertising", "warrant", "waived", "received", "copyleft", "verbatim", "invariant", "exception", "statically",
    "alternatively", "apache", "gnu", "openssl", "whatever", "dedicat", "perl", "jpeg", "accompanying", "agreement", "commercial", "only", "prohibited", "compile", "clause",
)
#: The same for short names, which count as whole words only.
GATE_SHORT = ("spdx", "cc", "gpl", "gfdl", "mpl", "epl", "edl", "cddl", "cpl", "eupl", "afl", "osl", "bsl", "busl", "sspl", "odbl", "odc", "ofl", "bsd", "pddl", "cecill", "mulan", "publicdomain")


def _gate(low: Column) -> Column:
    """Of a text in lower case, which must be a column of its own: an or tries its right side later, so each would lower it again."""
    some = lambda names: reduce(or_, [F.contains(low, F.lit(x)) for x in names])
    whole = low.rlike(rf"(?<![a-z0-9])(?:[al]?gplv?[0-9]*|[me]plv[0-9]|0bsd|cc0|{'|'.join(GATE_SHORT)})(?![a-z0-9])")
    return some(GATE) | F.when(some(GATE_SHORT), whole).otherwise(F.lit(False))


def _n_words(text: Column) -> Column:
    """Between two added words, each run of other characters ends one word more."""
    return (F.size(F.split(F.concat(F.lit("a "), text, F.lit(" a")), NOT_WORD_ANY_CASE)) - 2).cast("long")


def _plain(text: Column) -> Column:
    """The words with one space before, between and after."""
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" ")))).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(plain: Column, pattern: Column, block: int = 512) -> Column:
    """(start, end) of each match, in characters; gathered by blocks so that appending stays cheap."""
    empty = "array<struct<start:int,end:int>>"

    def one(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def many(state: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(state["at"].alias("at"), F.array().cast(empty).alias("out")), one)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    def all_of(found: Column) -> Column:
        gaps = F.slice(F.split(plain, pattern), 1, F.size(found))
        return F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))

    def folded(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / block).cast("int")), lambda i: F.slice(pairs, i * block + 1, F.lit(block)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{empty}>").alias("out")), many, lambda s: s["out"]))

    found = F.regexp_extract_all(plain, pattern, F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) > 0, _let(all_of(m), folded)).otherwise(F.array().cast(empty)))


def _constants() -> tuple[Column, Column, Column]:
    """All rules, all keywords, and the numbers of each keyword's rules, each read as one constant. Rules hold no quotes and no backslashes."""
    listed = rules()
    numbers: dict[str, list[int]] = {}
    for i, r in enumerate(listed):
        for k in r.keywords:
            numbers.setdefault(k, []).append(i)
    row = lambda i, r: f"named_struct('no',{i},'pattern',' (?:{r.pattern})(?= )','label','{r.label}','tier',{r.tier},'weight',{r.weight}D)"
    table = F.expr(f"array({','.join(row(i, r) for i, r in enumerate(listed))})")
    keys = F.expr(f"array({','.join(f"'{k}'" for k in numbers)})")
    return table, keys, F.expr(f"map({','.join(f"'{k}',array({','.join(map(str, n))})" for k, n in numbers.items())})")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, in one pass.

    Returns id_col, n_words, n_base, first_word, last_word (long; null without a base phrase),
    base_labels, labels (distinct, sorted, comma-joined; empty string for none), score (the best
    weight among detections that stand, 0 to 1) and detections (array of start and end in characters
    of the joined words, tier, label, weight; those that stand, in order). Null text: as the empty
    text. Very long texts are scanned whole. Null ids and repeated rows are kept as they are; empty table:
    no rows; columns not named are not read.
    """
    table, keys, numbers = _constants()
    base_re = F.lit(f" (?:{'|'.join(BASE)})(?= )")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", F.lower("t").alias("low"))
    rows = rows.select("id", _n_words(F.col("t")).alias("n_words"), F.when(_gate(F.col("low")), _plain(F.col("t"))).alias("plain"))
    plain = F.col("plain")
    detection = "start:int,less:int,tier:int,no:int,end:int,label:string,weight:double"
    words = F.array_intersect(keys, F.split(plain, " "))
    tried = F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda k: F.element_at(numbers, k)))))
    hits = F.transform(tried, lambda i: F.get(table, i))
    every = F.array_sort(F.flatten(F.transform(hits, lambda r: F.transform(_places(plain, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("less"), r["tier"].alias("tier"), r["no"].alias("no"), p["end"].alias("end"), r["label"].alias("label"), r["weight"].alias("weight"))))))
    rows = rows.select(
        "id",
        "n_words",
        "plain",
        F.when(plain.isNotNull(), F.regexp_count(plain, base_re).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(plain.isNotNull(), every).otherwise(F.array().cast(f"array<struct<{detection}>>")).alias("every"),
    )

    # sorted by start, then by end downwards: what contains a detection comes before it
    def step(s: Column, d: Column) -> Column:
        reach = F.when(d["tier"] == 0, s["m0"]).when(d["tier"] == 1, F.greatest(s["m0"], s["m1"])).otherwise(F.greatest(s["m0"], s["m1"], s["m2"]))
        over = reach >= d["end"]
        marks = [F.when(d["tier"] == k, F.greatest(s[f"m{k}"], d["end"])).otherwise(s[f"m{k}"]).alias(f"m{k}") for k in range(3)]
        return F.struct(*marks, F.concat(s["marks"], F.when(over, "0").otherwise("1")).alias("marks"))

    zero = F.struct(*[F.lit(-1).alias(f"m{k}") for k in range(3)], F.lit("").alias("marks"))
    marks = F.filter(F.split(F.aggregate("every", zero, step, lambda s: s["marks"]), ""), lambda m: m != "")
    rows = rows.withColumn("detections", F.array_compact(F.zip_with("every", marks, lambda d, m: F.when(m == "1", d))))
    at = F.regexp_instr(plain, base_re)
    before_last = F.regexp_extract(plain, f"(?s)^(.*) (?:{'|'.join(BASE)})(?= )", 1)
    base_labels = F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
    has = F.col("n_base") > 0
    none = F.array().cast("array<string>")
    base = F.when(has, F.array_sort(base_labels)).otherwise(none)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        F.when(has, _spaces(F.substring(plain, F.lit(1), at - 1))).alias("first_word"),
        F.when(has, _spaces(before_last)).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.transform("detections", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["tier"].alias("tier"), d["label"].alias("label"), d["weight"].alias("weight"))).alias("detections"),
    )
