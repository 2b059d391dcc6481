"""License scan: ordered signature rules over the words of a text.

A rule is a pattern over lower-case words with single spaces, a label, a priority and a keyword that every match
contains: names of licenses, sentences of their texts, addresses, short forms and identifiers. One pass of an automaton finds the keywords; only the rules of keywords that occur are tried. Of
overlapping detections, one that lies inside another of at least its priority is dropped; earlier rules win ties.
Places of the base phrases are counted on their own and keep their labels whatever else is found.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tabloom.llm import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}

# The base phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# label: (keyword, pattern of the name). A name's own words, most telling part as keyword.
NAMES = {
    "mit": ("mit license", r"(?:the )?(?:expat )?mit license"),
    "apache-2": ("apache license", r"(?:the )?apache license(?: version)? 2(?: 0)?"),
    "apache-1.1": ("apache", r"(?:the )?apache (?:software )?license(?: version)? 1 1"),
    "gpl-1": ("general public license", r"(?:the )?(?:gnu )?general public license(?: version| v)? ?1"),
    "gpl-2": ("general public license", r"(?:the )?(?:gnu )?general public license(?: version| v)? ?2"),
    "gpl-3": ("general public license", r"(?:the )?(?:gnu )?general public license(?: version| v)? ?3"),
    "lgpl-2": ("lesser general public", r"(?:the )?(?:gnu )?lesser general public license(?: version| v)? ?2(?! 1)"),
    "lgpl-2.1": ("lesser general public", r"(?:the )?(?:gnu )?lesser general public license(?: version| v)? ?2 1"),
    "lgpl-3": ("lesser general public", r"(?:the )?(?:gnu )?lesser general public license(?: version| v)? ?3"),
    "agpl-3": ("affero", r"(?:the )?(?:gnu )?affero general public license(?: version| v)? ?3"),
    "gfdl": ("free documentation", r"(?:the )?(?:gnu )?free documentation license"),
    "bsd-2": ("bsd", r"(?:the )?(?:simplified bsd|2 clause bsd|bsd 2 clause) license"),
    "bsd-3": ("bsd", r"(?:the )?(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause) license"),
    "bsd-4": ("bsd", r"(?:the )?(?:original bsd|4 clause bsd|bsd 4 clause) license"),
    "mpl-1.1": ("mozilla public", r"(?:the )?mozilla public license(?: version| v)? ?1 1"),
    "mpl-2": ("mozilla public", r"(?:the )?mozilla public license(?: version| v)? ?2"),
    "epl-1": ("eclipse public", r"(?:the )?eclipse public license(?: version| v)? ?1"),
    "epl-2": ("eclipse public", r"(?:the )?eclipse public license(?: version| v)? ?2"),
    "cddl": ("common development", r"(?:the )?common development and distribution license"),
    "cpl": ("common public", r"(?:the )?common public license"),
    "eupl": ("european union public", r"(?:the )?european union public licen[cs]e"),
    "artistic-2": ("artistic license", r"(?:the )?artistic license 2"),
    "artistic": ("artistic license", r"(?:the )?artistic license"),
    "isc": ("isc license", r"(?:the )?isc license"),
    "zlib": ("zlib", r"(?:the )?zlib(?: libpng)? license"),
    "boost": ("boost software", r"(?:the )?boost software license"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "wtfpl": ("wtfpl", r"(?:the )?wtfpl"),
    "python": ("python software", r"(?:the )?python software foundation license"),
    "php": ("php license", r"(?:the )?php license"),
    "openssl": ("openssl", r"(?:the )?openssl license"),
    "ofl": ("open font", r"(?:the )?(?:sil )?open font license"),
    "odbl": ("open database", r"(?:the )?open database license"),
    "odc-by": ("open data commons", r"(?:the )?open data commons attribution license"),
    "ms-pl": ("microsoft public", r"(?:the )?microsoft public license"),
    "ms-rl": ("microsoft reciprocal", r"(?:the )?microsoft reciprocal license"),
    "osl-3": ("open software license", r"(?:the )?open software license"),
    "afl": ("academic free", r"(?:the )?academic free license"),
    "ecl-2": ("educational community", r"(?:the )?educational community license"),
    "postgresql": ("postgresql license", r"(?:the )?postgresql license"),
    "ncsa": ("ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)? license"),
    "cc0": ("cc0", r"(?:the )?cc0(?: 1 0)?(?: universal)?"),
    "cc-by": ("creative commons", r"(?:the |a )?creative commons attribution(?: [1-4] [05])?(?: international)? license"),
    "cc-by-sa": ("creative commons", r"(?:the |a )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international)? license"),
    "cc-by-nd": ("creative commons", r"(?:the |a )?creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international)? license"),
    "cc-by-nc": ("creative commons", r"(?:the |a )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)? license"),
    "cc-by-nc-sa": ("creative commons", r"(?:the |a )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)? license"),
    "cc-by-nc-nd": ("creative commons", r"(?:the |a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international)? license"),
}
# Names of further licenses: (label, keyword, pattern of the name).
MORE_NAMES = [
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("0bsd", "zero clause bsd", r"zero clause bsd(?: license)?"),
    ("x11", "x11 license", r"x11 license"),
    ("curl", "curl license", r"curl license"),
    ("vim", "vim license", r"vim license"),
    ("ruby", "ruby", r"ruby(?: s)? license"),
    ("json", "json license", r"json license"),
    ("fair", "fair license", r"fair license"),
    ("beerware", "beer ware license", r"beer ware license"),
    ("blue-oak", "blue oak model", r"blue oak model license(?: 1 0 0)?"),
    ("upl", "universal permissive license", r"universal permissive license(?: v 1 0)?"),
    ("mulan-psl", "mulan permissive software", r"mulan permissive software license(?: v2)?"),
    ("cern-ohl", "cern open hardware", r"cern open hardware licen[cs]e"),
    ("sspl", "server side public license", r"server side public license"),
    ("busl", "business source license", r"business source license(?: 1 1)?"),
    ("elastic-2", "elastic license", r"elastic license(?: v ?2| 2 0)"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?"),
    ("polyform-nc", "polyform noncommercial", r"polyform noncommercial license"),
    ("polyform-sb", "polyform small business", r"polyform small business license"),
    ("parity", "parity public license", r"parity public license"),
    ("prosperity", "prosperity public license", r"prosperity public license"),
    ("hippocratic", "hippocratic license", r"hippocratic license"),
    ("openrail", "open rail", r"(?:creativeml |bigscience )?open rail(?: m)? license"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: license)?"),
    ("llama", "community license agreement", r"llama (?:[234] )?community license agreement"),
    ("ogl", "open government", r"open government licen[cs]e"),
    ("etalab", "licence ouverte", r"licence ouverte"),
    ("dl-de-by", "data licence germany", r"data licence germany attribution"),
    ("cdla-permissive", "community data license", r"community data license agreement permissive"),
    ("cdla-sharing", "community data license", r"community data license agreement sharing"),
    ("pddl", "public domain dedication and license", r"public domain dedication and license"),
    ("nosa", "nasa open source agreement", r"nasa open source agreement"),
    ("ipl", "ibm public license", r"ibm public license"),
    ("sissl", "sun industry standards", r"sun industry standards source license"),
    ("sleepycat", "sleepycat license", r"sleepycat license"),
    ("qpl", "q public license", r"q public license"),
    ("w3c", "w3c software", r"w3c software(?: notice and)?(?: document)? license"),
    ("unicode", "unicode license", r"unicode license(?: agreement)?"),
    ("apsl", "apple public source", r"apple public source license"),
    ("npl", "netscape public license", r"netscape public license"),
    ("nokos", "nokia open source", r"nokia open source license"),
    ("lucent", "lucent public license", r"lucent public license"),
    ("rpl", "reciprocal public license", r"reciprocal public license"),
    ("npos", "non profit open software", r"non profit open software license"),
    ("cpal", "common public attribution", r"common public attribution license"),
    ("apl", "adaptive public license", r"adaptive public license"),
    ("aal", "attribution assurance license", r"attribution assurance license"),
    ("efl", "eiffel forum license", r"eiffel forum license"),
    ("entessa", "entessa public license", r"entessa public license"),
    ("frameworx", "frameworx license", r"frameworx license"),
    ("motosoto", "motosoto", r"motosoto(?: open source)? license"),
    ("naumen", "naumen public license", r"naumen public license"),
    ("rscpl", "ricoh source code", r"ricoh source code public license"),
    ("watcom", "open watcom public", r"(?:sybase )?open watcom public license"),
    ("vsl", "vovida software license", r"vovida software license"),
    ("wxwindows", "wxwindows library", r"wxwindows library licen[cs]e"),
    ("zpl", "zope public license", r"zope public license"),
    ("lppl", "latex project public", r"latex project public license"),
    ("aladdin", "aladdin free public", r"aladdin free public license"),
    ("cecill", "cecill", r"cecill(?: b| c)?(?: license)?"),
    ("osl-2", "open software license", r"open software license(?: v(?:ersion)?)? 2 [01]"),
    ("artistic-1", "artistic license", r"artistic license 1 0"),
    ("gfdl", "gnu fdl", r"gnu fdl"),
    ("lgpl", "library general public", r"(?:gnu )?library general public license"),
]
# What may stand before a name: (pattern, priority of the detection with it). A fuller sentence outranks the bare name.
LEADS = [(re.compile(f"(?<= )(?:{p} )$"), priority) for p, priority in [
    (r"(?:(?:is|are) )?(?:re)?(?:licensed|released|distributed|published|available|provided) under(?: the terms (?:and conditions )?of)?", 90),
    (r"(?:subject|according|pursuant) to(?: the terms of)?", 80),
    (r"(?:see|read|a copy of|terms of)", 70),
]]
LATER = re.compile(r" or (?:any|at your option any) later(?: version)?(?= )")
NAME, NAME_LATER = 50, 60
# Rules of their own: (label, keyword, pattern, priority).
SINGLE = [
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 40),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain", 80),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 95),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software", 95),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted", 95),
    ("gpl", "general public license", r"(?:gnu )?general public license", 30),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public license", 35),
    ("bsd", "bsd license", r"bsd license", 30),
    ("apache", "apache license", r"apache license", 30),
    ("creative-commons", "creative commons", r"creative commons(?: licen[cs]e)?", 30),
    ("cc-by", "cc by", r"cc by(?! (?:nc|nd|sa))(?: [1-4] [05])?", 55),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", 60),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", 60),
    ("cc-by-nc", "cc by", r"cc by nc(?! (?:sa|nd))(?: [1-4] [05])?", 60),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", 65),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", 65),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 40),
    ("commercial", "commercial license", r"(?:under a |requires a )?commercial license", 40),
]
_PUBLISHED = r"general public license as published by the free software foundation (?:either )?version "
# Sentences of the license texts: (label, keyword, pattern, priority).
SENTENCES = [
    ("mit", "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 92),
    ("apache-2", "you may not use this file except in compliance", r"apache license version 2 0 the license you may not use this file except in compliance with the license", 95),
    ("gpl-2", "as published by the free software foundation", rf"gnu {_PUBLISHED}2", 95),
    ("gpl-3", "as published by the free software foundation", rf"gnu {_PUBLISHED}3", 95),
    ("lgpl-2", "as published by the free software foundation", rf"gnu (?:lesser|library) {_PUBLISHED}2(?! 1)", 95),
    ("lgpl-2.1", "as published by the free software foundation", rf"gnu lesser {_PUBLISHED}2 1", 95),
    ("lgpl-3", "as published by the free software foundation", rf"gnu lesser {_PUBLISHED}3", 95),
    ("agpl-3", "as published by the free software foundation", rf"gnu affero {_PUBLISHED}3", 95),
    ("mpl-2", "this source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", 95),
    ("boost", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 95),
    ("zlib", "in no event will the authors be held liable", r"provided as is without any express or implied warranty in no event will the authors be held liable", 90),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 95),
    ("wtfpl", "do what the fuck you want to", r"do what the fuck you want to public license", 95),
    ("bsd-4", "all advertising materials mentioning features", r"all advertising materials mentioning features or use of this software must display", 95),
    ("cc0", "related or neighboring rights", r"waived all copyright and related or neighboring rights", 92),
]
SENTENCES += [
    ("mit", "shall be included in all copies", r"shall be included in all copies or substantial portions of the software", 88),
    ("bsd-3", "neither the name of", r"neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products", 93),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice", 85),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice", 85),
    ("isc", "with or without fee is hereby granted", r"software for any purpose with or without fee is hereby granted", 90),
    ("apache-2", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements", 94),
    ("apache-2", "distributed under the license is distributed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 93),
    ("apache", "this product includes software developed by the apache", r"this product includes software developed by the apache (?:group|software foundation)", 80),
    ("gpl", "you can redistribute it and or modify it", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license", 85),
    ("lgpl", "you can redistribute it and or modify it", r"is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 86),
    ("agpl-3", "you can redistribute it and or modify it", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 87),
    ("gpl", "along with this program", r"you should have received a copy of the gnu general public license along with this program", 85),
    ("lgpl", "along with this library", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library", 85),
    ("gpl-2", "designed to take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 92),
    ("gpl-3", "free copyleft license", r"is a free copyleft license for software and other kinds of works", 92),
    ("lgpl-3", "incorporates the terms and conditions of version 3", r"incorporates the terms and conditions of version 3 of the gnu general public license", 94),
    ("agpl-3", "remote network interaction", r"remote network interaction use with the gnu general public license", 92),
    ("gfdl", "functional and useful document", r"make a manual textbook or other functional and useful document free", 93),
    ("gfdl", "distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 94),
    ("mpl-1.1", "contents of this file are subject to", r"the contents of this file are subject to the mozilla public license version 1 1", 95),
    ("cddl", "contents of this file are subject to", r"the contents of this file are subject to the terms of the common development and distribution license", 95),
    ("npl", "contents of this file are subject to", r"the contents of this file are subject to the netscape public license", 95),
    ("epl", "accompanying materials are made available", r"accompanying materials are made available under the terms of the eclipse public license", 90),
    ("artistic", "conditions under which a package", r"state the conditions under which a package may be copied", 90),
    ("artistic-2", "terms under which a given free software package", r"establishes the terms under which a given free software package may be copied modified distributed", 93),
    ("zlib", "including commercial applications", r"permission is granted to anyone to use this software for any purpose including commercial applications", 91),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented", 90),
    ("zlib", "must be plainly marked", r"altered source versions must be plainly marked as such", 90),
    ("boost", "this entire statement", r"the copyright notices in the software and this entire statement including the above license grant", 92),
    ("postgresql", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted", 93),
    ("openssl", "software developed by the openssl project", r"this product includes software developed by the openssl project", 90),
    ("ssleay", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young", 90),
    ("php", "this product includes php", r"this product includes php(?: software)? freely available from", 90),
    ("python", "psf is making python", r"psf is making python (?:\S+ ){0,4}available to licensee on an as is basis", 93),
    ("ofl", "this font software is licensed", r"this font software is licensed under the sil open font license", 94),
    ("ofl", "obtaining a copy of the font software", r"any person obtaining a copy of the font software", 92),
    ("unlicense", "anyone is free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software", 92),
    ("wtfpl", "changing it is allowed as long as", r"changing it is allowed as long as the name is changed", 92),
    ("cc-by", "you must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 56),
    ("cc-by-sa", "distribute your contributions under the same license", r"you must distribute your contributions under the same license as the original", 75),
    ("cc-by-nd", "may not distribute the modified material", r"build upon the material you may not distribute the modified material", 75),
    ("cc-by-nc", "material for commercial purposes", r"you may not use the material for commercial purposes", 75),
    ("cc0", "dedicated the work to the public domain", r"associated a work with this deed has dedicated the work to the public domain", 94),
    ("ms-pl", "accept this license", r"if you use the software you accept this license", 80),
    ("odbl", "database contents license", r"individual contents of the database are licensed under the database contents license", 92),
    ("cecill", "governed by the cecill", r"software is governed by the cecill(?: b| c)? license under french law", 93),
    ("busl", "governed by the business source license", r"use of this software is governed by the business source license", 94),
    ("json", "used for good not evil", r"the software shall be used for good not evil", 92),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 92),
    ("fair", "usage of the works is permitted", r"usage of the works is permitted provided that this instrument is retained", 93),
    ("ncsa", "university of illinois", r"nor the names of (?:\S+ ){0,6}university of illinois", 85),
    ("eupl", "licensed under the eupl", r"licensed under the eupl", 85),
    ("sspl", "making the functionality of the program", r"making the functionality of the program available to third parties as a service", 80),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 60),
    ("proprietary", "may not be reproduced", r"may not be reproduced (?:\S+ ){0,4}without (?:the )?(?:prior |express )*written (?:permission|consent)", 55),
    ("proprietary", "trade secrets", r"contains (?:confidential information and )?trade secrets", 50),
    ("eula", "end user license agreement", r"end user license agreement", 40),
    ("public-domain", "public domain", r"(?:is|are) in the public domain", 60),
    ("public-domain", "no copyright", r"no copyright is claimed", 60),
    ("public-domain", "work of the united states government", r"work of the united states government", 55),
]
# Addresses of license texts, as words.
ADDRESSES = [
    ("apache-2", "apache org licenses", r"apache org licenses license 2 0"), ("apache-1.1", "apache org licenses", r"apache org licenses license 1 1"),
    ("mit", "opensource org", r"opensource org licenses? mit"), ("isc", "opensource org", r"opensource org licenses? isc"),
    ("bsd-2", "opensource org", r"opensource org licenses? bsd 2 clause"), ("bsd-3", "opensource org", r"opensource org licenses? bsd 3 clause"),
    ("gpl-3", "gnu org licenses", r"gnu org licenses gpl 3 0"), ("gpl-2", "gnu org licenses", r"gnu org licenses old licenses gpl 2 0"),
    ("lgpl-3", "gnu org licenses", r"gnu org licenses lgpl 3 0"), ("lgpl-2.1", "gnu org licenses", r"gnu org licenses old licenses lgpl 2 1"),
    ("agpl-3", "gnu org licenses", r"gnu org licenses agpl 3 0"), ("gfdl", "gnu org licenses", r"gnu org licenses fdl"),
    ("cc-by", "creativecommons org licenses", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("mpl-2", "mozilla org mpl", r"mozilla org mpl 2 0"), ("mpl-1.1", "mozilla org mpl", r"mozilla org mpl mpl 1 1"),
    ("epl-1", "eclipse org legal", r"eclipse org legal epl v10"), ("epl-2", "eclipse org legal", r"eclipse org legal epl (?:v20|2 0)"),
    ("unlicense", "unlicense org", r"unlicense org"), ("wtfpl", "wtfpl net", r"wtfpl net"), ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("boost", "boost org license", r"boost org license 1 0"), ("odbl", "opendatacommons org licenses", r"opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses", r"opendatacommons org licenses by"), ("pddl", "opendatacommons org licenses", r"opendatacommons org licenses pddl"),
    ("php", "php net license", r"php net license 3 0[01]?"), ("python", "python org psf", r"python org psf(?: license)?"),
    ("zlib", "zlib net zlib", r"zlib net zlib license"), ("artistic-2", "perlfoundation org", r"perlfoundation org artistic license 2 0"),
    ("cecill", "cecill info", r"cecill info"), ("postgresql", "postgresql org about", r"postgresql org about licen[cs]e"),
]
_LATER = r"(?: only| or later)?"
# SPDX ids as words: (label, pattern). They count after "SPDX-License-Identifier", and where that stands after "id or" and "id and".
SPDX = [
    *[(f"gpl-{n}", rf"gpl {n} 0{_LATER}") for n in (1, 2, 3)],
    ("lgpl-2", rf"lgpl 2 0{_LATER}"), ("lgpl-2.1", rf"lgpl 2 1{_LATER}"), ("lgpl-3", rf"lgpl 3 0{_LATER}"),
    ("agpl-3", rf"agpl 3 0{_LATER}"), ("gfdl", rf"gfdl 1 [1-3]{_LATER}"),
    ("mit", r"mit"), ("isc", r"isc"), ("zlib", r"zlib"), ("boost", r"bsl 1 0"), ("apache-1.1", r"apache 1 1"),
    ("apache-2", r"apache 2 0"), ("bsd-2", r"bsd 2 clause"), ("bsd-3", r"bsd 3 clause"), ("bsd-4", r"bsd 4 clause"),
    ("mpl-1.1", r"mpl 1 1"), ("mpl-2", r"mpl 2 0"), ("epl-1", r"epl 1 0"), ("epl-2", r"epl 2 0"), ("cddl", r"cddl 1 [01]"),
    ("eupl", r"eupl 1 [0-2]"), ("artistic-2", r"artistic 2 0"), ("ofl", r"ofl 1 1"), ("python", r"psf 2 0"),
    ("php", r"php 3 0[01]?"), ("postgresql", r"postgresql"), ("ncsa", r"ncsa"), ("afl", r"afl 3 0"), ("osl-3", r"osl 3 0"),
]
_AFTER_ID = "|".join(f"(?<= {w} )" for w in ("0", "1", "2", "3", "clause", "only", "later", "mit", "isc", "zlib", "postgresql", "ncsa"))
# Short forms that stand alone: (label, keyword, pattern, priority).
SHORT = [
    *[(f"{f}-{n}", k, rf"(?:gnu )?(?:{f}v?{n}|{f} (?:version |v ?)?{n})(?: 0)?{_LATER}", 45)
      for f, n in (("gpl", 1), ("gpl", 2), ("gpl", 3), ("lgpl", 3), ("agpl", 3)) for k in (f, f"{f}{n}", f"{f}v{n}")],
    *[("lgpl-2.1", k, rf"(?:gnu )?(?:lgplv?2 1|lgpl (?:version |v ?)?2 1){_LATER}", 46) for k in ("lgpl", "lgpl2", "lgplv2")],
    *[("lgpl-2", k, rf"(?:gnu )?(?:lgplv?2|lgpl (?:version |v ?)?2)(?! 1)(?: 0)?{_LATER}", 45) for k in ("lgpl", "lgpl2", "lgplv2")],
    *[(f, f, rf"(?:gnu )?{f}", 30) for f in ("gpl", "lgpl", "agpl")],
    ("apache-2", "apache", r"apache (?:version |v)?2 0", 45), ("apache-2", "apache", r"apache 2 licensed", 45), ("apache-2", "apachev2", r"apachev2", 45),
    ("mit", "mit licensed", r"mit licensed", 45),
    *[(f"bsd-{n}", "bsd", rf"(?:bsd {n} clause|{n} clause bsd)", 45) for n in (2, 3, 4)],
    ("bsd", "bsd licensed", r"bsd licensed", 30), ("mpl-2", "mplv2", r"mplv2(?: 0)?", 45),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: names, the single ones, sentences, addresses, short forms and SPDX ids."""
    made = [(label, keyword, name, NAME) for label, (keyword, name) in NAMES.items()]
    made += [(label, keyword, f"(?:the )?{name}", NAME) for label, keyword, name in MORE_NAMES] + SINGLE + SENTENCES
    made += [(label, keyword, name, 85) for label, keyword, name in ADDRESSES] + SHORT
    made += [(label, "spdx license identifier", f"spdx license identifier {name}", 98) for label, name in SPDX]
    made += [(label, "spdx license identifier", f"(?:{_AFTER_ID})(?:or|and) {name}", 97) for label, name in SPDX]
    return tuple(Rule(label, keyword, re.compile(f"(?<= ){pattern}(?= )"), priority)
                 for label, keyword, pattern, priority in made)


def spans_of(line: str, i: int) -> list[tuple[int, int, int, int]]:
    """(start, end, priority, rule) of every place of a rule in a line of words. A name takes in what stands before it
    and "or any later version" behind it, and then counts for more."""
    out = []
    for m in rules()[i].pattern.finditer(line):
        start, end, priority = m.start(), m.end(), rules()[i].priority
        if priority == NAME:
            later = LATER.match(line, end)
            if later:
                end, priority = later.end(), NAME_LATER
            before = line[max(0, start - 80):start]
            for lead, more in LEADS:
                found = lead.search(before)
                if found:
                    start, priority = start - (len(before) - found.start()), max(more, priority)
                    break
        out.append((start, end, priority, i))
    return out


@functools.cache
def _gate() -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        found.setdefault(rule.keyword, []).append(i)
    gate = ahocorasick.Automaton()
    for phrase in BASE:
        found.setdefault(phrase, [])
    for keyword, at in found.items():
        gate.add_word(f" {keyword} ", (keyword, tuple(at)))
    gate.make_automaton()
    return gate


def suppress(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule), those not inside another of at least their priority; the first rule of equals.

    One pass in order of start, longer and then higher first, with the furthest end so far of each priority.
    """
    furthest: dict[int, int] = {}
    kept = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        start, end, priority, _ = span
        if not any(p >= priority and e >= end for p, e in furthest.items()):
            kept.append(span)
        furthest[priority] = max(furthest.get(priority, -1), end)
    return kept


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = WORD.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())
    line = f" {' '.join(words)} "
    seen: set[str] = set()
    tried: set[int] = set()
    for _, (keyword, at) in _gate().iter(line):
        seen.add(keyword)
        tried.update(at)
    if not seen:
        return len(words), 0, None, None, "", "", 0.0
    starts: list[int] = []
    base: set[str] = set()
    edges = np.array([m.start() for m in re.finditer(" ", line)])
    for phrase in BASE.keys() & seen:
        at = [m.start() for m in re.finditer(f"(?={re.escape(f' {phrase} ')})", line)]
        starts += np.searchsorted(edges, at).tolist()
        base.add(BASE[phrase])
    spans = [span for i in sorted(tried) for span in spans_of(line, i)]
    kept = suppress(spans)
    labels = base | {rules()[i].label for *_, i in kept}
    score = max([p / 100 for _, _, p, _ in kept] + [1.0 if base else 0.0])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and what `scan_text` finds for every row of ``docs`` (text), over its whole text.

    A null or wordless text has no words, no places and empty labels, and scores 0. The score is the priority of
    the best detection left, in hundredths; a base phrase scores 1. Repeated rows are scanned alike.
    """
    return common.map_texts(
        docs, keep, "text", "n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double", lambda texts: list(zip(*map(scan_text, texts))) or [[]] * 7)
