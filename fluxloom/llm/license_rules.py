"""Signature rules for license detection.

One rule per line: ``label | priority | keyword | pattern``. Patterns are matched against text
with A-Z lower-cased. In a pattern a blank stands for any run of characters that are
neither letters nor digits (so line breaks and comment marks may separate the words), ``<ver>``
for the words before a version number. Tags are looked for in the whole expression behind "SPDX-License-Identifier:". A rule is only tried on texts that hold its keyword (or one of
several, parted by "or"), so every match must hold it; any separator may stand for a blank there too.
Priorities: 9 full notice, 7 versioned name or tag, 5 name, 3 general mention.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

RULES = r"""
mit | 9 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 9 | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify
mit | 8 | substantial portions | shall be included in all copies or substantial portions of the software
mit | 7 | mit licen | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit | 6 | mit | (?:the )?mit[ -]?style licen[sc]e
mit | 5 | mit licen | mit licen[sc]e
mit | 5 | expat | expat licen[sc]e
mit-0 | 7 | mit no attribution | mit no attribution
x11 | 6 | x11 licen | x11 licen[sc]e
x11 | 8 | x consortium | the name of the x consortium shall not be used in advertising
isc | 9 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 6 | isc licen | isc licen[sc]e
hpnd | 8 | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose
apache-2.0 | 9 | apache | licensed under the apache license <ver> 2(?:\.0)?
apache-2.0 | 9 | apache.org | (?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0
apache-2.0 | 8 | apache | apache licen[sc]e <ver> 2(?:\.0)?
apache-2.0 | 7 | apache | apache(?: software)? licen[sc]e 2(?:\.0)?
apache-2.0 | 7 | apache | apache[ -]?2(?:\.0)? licen[sc]e
apache-2.0 | 6 | asl 2 | asl 2(?:\.0)?
apache-1.1 | 8 | apache | apache(?: software)? licen[sc]e <ver> 1\.1
apache-1.0 | 8 | apache | apache(?: software)? licen[sc]e <ver> 1\.0
apache | 5 | apache licen | apache licen[sc]e
apache | 5 | apache software licen | apache software licen[sc]e
gpl-3.0-or-later | 9 | gnu general public | gnu general public license as published by the free software foundation either <ver> 3 of the license or at your option any later version
gpl-2.0-or-later | 9 | gnu general public | gnu general public license as published by the free software foundation either <ver> 2 of the license or at your option any later version
gpl-3.0 | 8 | general public licen | (?:gnu )?general public licen[sc]e <ver> 3(?:\.0)?
gpl-2.0 | 8 | general public licen | (?:gnu )?general public licen[sc]e <ver> 2(?:\.0)?
gpl-1.0 | 8 | general public licen | (?:gnu )?general public licen[sc]e <ver> 1(?:\.0)?
gpl-3.0 | 7 | gpl | (?:gnu )?gpl[ -]?<v>?3(?:\.0)?
gpl-2.0 | 7 | gpl | (?:gnu )?gpl[ -]?<v>?2(?:\.0)?
gpl-3.0 | 8 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-3\.0
gpl-2.0 | 8 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl | 6 | gnu general public | gnu general public licen[sc]e
gpl | 5 | general public licen | general public licen[sc]e
gpl | 4 | gnu gpl | gnu gpl
gpl-classpath | 8 | classpath | classpath exception
gpl-font | 8 | font exception | gpl font exception
gpl-linking | 8 | linking exception | (?:static )?linking exception
lgpl-3.0 | 8 | lesser general public | lesser general public licen[sc]e <ver> 3(?:\.0)?
lgpl-2.1 | 8 | lesser general public | lesser general public licen[sc]e <ver> 2\.1
lgpl-2.1 | 9 | lesser general public | gnu lesser general public license as published by the free software foundation either <ver> 2\.1 of the license
lgpl-3.0 | 9 | lesser general public | gnu lesser general public license as published by the free software foundation either <ver> 3 of the license
lgpl-2.0 | 8 | library general public | library general public licen[sc]e <ver> 2(?:\.0)?
lgpl-3.0 | 7 | lgpl | lgpl[ -]?<v>?3(?:\.0)?
lgpl-2.1 | 7 | lgpl | lgpl[ -]?<v>?2\.1
lgpl-2.0 | 7 | lgpl | lgpl[ -]?<v>?2(?:\.0)?(?!\.1)
lgpl | 6 | lesser general public | (?:gnu )?lesser general public licen[sc]e
lgpl | 6 | library general public | (?:gnu )?library general public licen[sc]e
agpl-3.0 | 8 | affero | affero general public licen[sc]e <ver> 3(?:\.0)?
agpl-1.0 | 8 | affero | affero general public licen[sc]e <ver> 1(?:\.0)?
agpl-3.0 | 7 | agpl | agpl[ -]?<v>?3(?:\.0)?
agpl | 6 | affero | (?:gnu )?affero general public licen[sc]e
gfdl | 6 | free documentation | (?:gnu )?free documentation licen[sc]e
gfdl-1.3 | 8 | free documentation | (?:gnu )?free documentation licen[sc]e <ver> 1\.3
gfdl-1.2 | 8 | free documentation | (?:gnu )?free documentation licen[sc]e <ver> 1\.2
gfdl-1.1 | 8 | free documentation | (?:gnu )?free documentation licen[sc]e <ver> 1\.1
bsd-3-clause | 9 | neither the name | neither the name of (?:the )?(?:copyright holder|author|[^.\n]{1,60}) nor the names of (?:its|the|their) contributors may be used to endorse
bsd-2-clause | 8 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-4-clause | 9 | all advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause | 7 | bsd | bsd[ -]?3[ -]?clause(?![ -]clear)(?: licen[sc]e)?
bsd-3-clause-clear | 7 | clear | bsd[ -]?3[ -]?clause[ -]clear(?: licen[sc]e)?
bsd-2-clause | 7 | bsd | bsd[ -]?2[ -]?clause(?: licen[sc]e)?
bsd-4-clause | 7 | bsd | bsd[ -]?4[ -]?clause(?: licen[sc]e)?
bsd-3-clause | 7 | bsd | (?:3|three)[ -]clause bsd(?: licen[sc]e)?
bsd-2-clause | 7 | bsd | (?:2|two)[ -]clause bsd(?: licen[sc]e)?
bsd-4-clause | 7 | bsd | (?:4|four)[ -]clause bsd(?: licen[sc]e)?
bsd-3-clause | 7 | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-2-clause | 7 | bsd | (?:simplified|free) bsd licen[sc]e
bsd-4-clause | 7 | bsd | (?:original|old) bsd licen[sc]e
0bsd | 7 | bsd | (?:zero[ -]clause bsd|0bsd|bsd zero clause licen[sc]e)
bsd | 5 | bsd | bsd(?:[ -]style)? licen[sc]e
mpl-2.0 | 9 | mozilla public | subject to the terms of the mozilla public license <ver>? ?2\.0
mpl-2.0 | 8 | mozilla public | mozilla public licen[sc]e <ver> 2(?:\.0)?
mpl-1.1 | 8 | mozilla public | mozilla public licen[sc]e <ver> 1\.1
mpl-1.0 | 8 | mozilla public | mozilla public licen[sc]e <ver> 1\.0
mpl-2.0 | 7 | mozilla.org | mozilla\.org/mpl/2\.0
mpl-2.0 | 7 | mpl | mpl[ -]?<v>?2(?:\.0)?
mpl | 5 | mozilla public | mozilla public licen[sc]e
epl-2.0 | 8 | eclipse public | eclipse public licen[sc]e <ver>? ?2(?:\.0)?
epl-1.0 | 8 | eclipse public | eclipse public licen[sc]e <ver>? ?1(?:\.0)?
epl | 5 | eclipse public | eclipse public licen[sc]e
edl-1.0 | 7 | eclipse distribution | eclipse distribution licen[sc]e
cddl-1.1 | 8 | common development | common development and distribution licen[sc]e <ver>? ?1\.1
cddl-1.0 | 8 | common development | common development and distribution licen[sc]e <ver>? ?1\.0
cddl | 5 | common development | common development and distribution licen[sc]e
cpl-1.0 | 7 | common public licen | common public licen[sc]e(?: <ver> 1\.0)?
cpal-1.0 | 7 | common public attribution | common public attribution licen[sc]e
ipl-1.0 | 7 | ibm public | ibm public licen[sc]e
apsl-2.0 | 8 | apple public | apple public source licen[sc]e <ver>? ?2(?:\.0)?
apsl | 5 | apple public | apple public source licen[sc]e
nposl-3.0 | 7 | non-profit open | non-profit open software licen[sc]e
osl-3.0 | 8 | open software licen | open software licen[sc]e <ver>? ?3(?:\.0)?
osl | 5 | open software licen | open software licen[sc]e
afl-3.0 | 8 | academic free | academic free licen[sc]e <ver>? ?3(?:\.0)?
afl | 5 | academic free | academic free licen[sc]e
artistic-2.0 | 8 | artistic | artistic licen[sc]e <ver>? ?2(?:\.0)?
artistic-1.0 | 8 | artistic | artistic licen[sc]e <ver>? ?1(?:\.0)?
artistic | 5 | artistic | artistic licen[sc]e
perl | 7 | perl itself | (?:under )?the same terms as perl itself
ruby | 6 | ruby | ruby(?:'s)? licen[sc]e
python-2.0 | 7 | python software foundation | python software foundation licen[sc]e(?: <ver> 2)?
psf | 6 | psf licen | psf licen[sc]e
php-3.01 | 8 | php licen | php licen[sc]e <ver>? ?3\.01
php | 5 | php licen | php licen[sc]e
zend-2.0 | 6 | zend engine | zend engine licen[sc]e
zlib | 9 | as-is | this software is provided as-is without any express or implied warranty in no event will the authors be held liable
zlib | 6 | zlib | zlib(?:[ -]?libpng)? licen[sc]e
libpng | 6 | libpng | libpng licen[sc]e
bsl-1.0 | 8 | boost software | boost software licen[sc]e(?: <ver> 1\.0)?
bsl-1.0 | 7 | boost.org | boost\.org/license_1_0\.txt
busl-1.1 | 8 | business source | business source licen[sc]e(?: <ver>? ?1\.1)?
elastic-2.0 | 7 | elastic licen | elastic licen[sc]e(?: <ver>? ?2(?:\.0)?)?
sspl-1.0 | 8 | server side public | server side public licen[sc]e(?: <ver>? ?1)?
commons-clause | 7 | commons clause | commons clause(?: licen[sc]e condition)?
polyform-noncommercial | 7 | polyform | polyform noncommercial(?: licen[sc]e)?
polyform-shield | 7 | polyform | polyform shield(?: licen[sc]e)?
polyform-small-business | 7 | polyform | polyform small business(?: licen[sc]e)?
fsl-1.1 | 7 | functional source | functional source licen[sc]e
unlicense | 9 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 6 | unlicense | (?:the )?unlicense
wtfpl | 9 | do what the | do what the f[^\s]{1,3}k you want to public licen[sc]e
wtfpl | 6 | wtfpl | wtfpl
beerware | 7 | beer-ware | beer-ware licen[sc]e
beerware | 7 | buy me a beer | you can buy me a beer in return
public-domain | 7 | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | 5 | public domain | public domain dedication
public-domain | 3 | public domain | in the public domain
postgresql | 6 | postgresql licen | postgresql licen[sc]e
openssl | 7 | openssl | openssl(?: toolkit)? licen[sc]e
ssleay | 7 | ssleay | (?:original )?ssleay licen[sc]e
curl | 6 | curl licen | curl licen[sc]e
ncsa | 7 | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
w3c | 6 | w3c | w3c software (?:notice and )?licen[sc]e
unicode-dfs | 7 | unicode | unicode(?: inc)? licen[sc]e agreement
icu | 6 | icu licen | icu licen[sc]e
ijg | 7 | independent jpeg | independent jpeg group(?:'s)?(?: licen[sc]e| software)
ftl | 7 | freetype | freetype(?: project)? licen[sc]e
ofl-1.1 | 8 | open font | (?:sil )?open font licen[sc]e <ver>? ?1\.1
ofl | 6 | open font | (?:sil )?open font licen[sc]e
lppl-1.3c | 8 | latex project public | latex project public licen[sc]e(?: <ver>? ?1\.3c?)?
knuth-ctan | 5 | knuth | knuth ctan licen[sc]e
tcl | 6 | tcl | tcl(?:/tk)? licen[sc]e
vim | 6 | vim licen | vim licen[sc]e
sleepycat | 6 | sleepycat | sleepycat licen[sc]e
qpl-1.0 | 6 | q public | q public licen[sc]e
eupl-1.2 | 8 | european union public | european union public licen[sc]e <ver>? ?1\.2
eupl-1.1 | 8 | european union public | european union public licen[sc]e <ver>? ?1\.1
eupl | 6 | european union public | european union public licen[sc]e
cecill-2.1 | 8 | cecill | cecill(?: free software licen[sc]e)?(?: agreement)? <ver>? ?2\.1
cecill-b | 7 | cecill | cecill-b
cecill-c | 7 | cecill | cecill-c
cecill | 5 | cecill | cecill
mulan-psl-2.0 | 8 | mulan | mulan (?:psl|permissive software licen[sc]e) ?<v>?2
mulan-psl | 6 | mulan | mulan (?:psl|permissive software licen[sc]e)
upl-1.0 | 7 | universal permissive | universal permissive licen[sc]e
blueoak-1.0.0 | 7 | blue oak | blue oak model licen[sc]e
ecl-2.0 | 7 | educational community | educational community licen[sc]e(?: <ver>? ?2\.0)?
catosl-1.1 | 6 | computer associates | computer associates trusted open source licen[sc]e
nokia | 6 | nokia open | nokia open source licen[sc]e
intel | 6 | intel open | intel open source licen[sc]e
nasa-1.3 | 7 | nasa open | nasa open source agreement
ms-pl | 7 | microsoft public | microsoft public licen[sc]e
ms-rl | 7 | microsoft reciprocal | microsoft reciprocal licen[sc]e
ms-lpl | 6 | microsoft limited | microsoft limited public licen[sc]e
rpl-1.5 | 7 | reciprocal public | reciprocal public licen[sc]e(?: <ver>? ?1\.5)?
rpsl-1.0 | 6 | realnetworks | realnetworks public source licen[sc]e
sissl | 6 | sun industry | sun industry standards source licen[sc]e
spl-1.0 | 6 | sun public | sun public licen[sc]e
npl-1.1 | 7 | netscape public | netscape public licen[sc]e(?: <ver>? ?1\.1)?
interbase | 5 | interbase | interbase public licen[sc]e
xfree86 | 6 | xfree86 | xfree86 licen[sc]e
watcom | 5 | watcom | sybase open watcom public licen[sc]e
json | 7 | good, not evil | the software shall be used for good not evil
odbl-1.0 | 7 | open database | open database licen[sc]e
odc-by-1.0 | 7 | open data commons | open data commons attribution licen[sc]e
pddl-1.0 | 7 | open data commons | open data commons public domain dedication
odc | 4 | open data commons | open data commons
ogl-uk-3.0 | 7 | open government | open government licen[sc]e <ver>? ?3(?:\.0)?
ogl | 5 | open government | open government licen[sc]e
etalab-2.0 | 6 | etalab or licence ouverte | (?:etalab|licence ouverte)(?: <v>?2\.0)?
cdla-permissive | 7 | community data | community data licen[sc]e agreement permissive
cdla-sharing | 7 | community data | community data licen[sc]e agreement sharing
cc0-1.0 | 8 | cc0 | cc0(?: 1\.0)?(?: universal)?
cc0-1.0 | 8 | publicdomain/zero | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm-1.0 | 8 | publicdomain/mark | creativecommons\.org/publicdomain/mark/1\.0
cc | 4 | creative commons | creative commons(?: licen[sc]e)?
openrail-m | 7 | openrail | (?:creativeml )?(?:bigscience )?openrail(?:-m)?(?: licen[sc]e)?
llama-community | 7 | llama | llama ?\d?(?:\.\d)? community licen[sc]e(?: agreement)?
gemma-terms | 6 | gemma | gemma terms of use
gpl-compatible | 3 | compatible | gpl[ -]compatible
dual-license | 5 | dual | dual[ -]licen[sc]ed
proprietary | 7 | proprietary | proprietary and confidential
proprietary | 7 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 5 | all rights reserved | copyright [^\n]{0,80}all rights reserved
proprietary | 3 | all rights reserved | all rights reserved
proprietary | 6 | no part of this | no part of this [a-z]{3,12} may be reproduced
eula | 6 | end user licen | end[ -]user licen[sc]e agreement
eula | 5 | eula | (?:subject to|accept) the eula
shareware | 5 | shareware | shareware(?: licen[sc]e| version)
freeware | 5 | freeware | freeware(?: licen[sc]e)?
trial | 4 | evaluation | evaluation licen[sc]e
non-commercial | 5 | non-commercial | (?:for )?non-commercial use only
academic-only | 5 | academic use | (?:for )?academic use only
research-only | 5 | research | for research purposes only
no-derivatives | 4 | derivative | no derivative works
share-alike | 4 | alike licen | share-?alike licen[sc]e
copyleft | 3 | copyleft | copyleft licen[sc]e
permissive | 3 | permissive | permissive (?:free |open )?(?:software |source )?licen[sc]e
open-source | 3 | open source | open source licen[sc]e
free-software | 3 | free software | free software licen[sc]e
see-license | 3 | see the | see the (?:accompanying )?licen[sc]e(?: file)? for
see-license | 3 | found in the | can be found in the licen[sc]e file
warranty-disclaimer | 4 | warrant | without warranty of any kind(?: express or implied)?
warranty-disclaimer | 4 | warrant | distributed on an as is basis without warranties or conditions of any kind
warranty-disclaimer | 4 | warrant | without even the implied warranty of merchantability or fitness for a particular purpose
"""

# Tags whose license can be named by "SPDX-License-Identifier:" and by a package manifest.
TAGS = """0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause
bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc0-1.0 cddl-1.0 cecill-2.1
ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-2.0 ms-pl ncsa ofl-1.1 osl-3.0 postgresql python-2.0
unlicense upl-1.0 wtfpl zlib"""
CC_PARTS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    within: re.Pattern | None = None

    def matches(self, text: str) -> Iterator[re.Match]:
        """The places of the pattern, in the first group of ``within`` if the rule has one."""
        if self.within is None:
            return self.pattern.finditer(text)
        return (m for part in self.within.finditer(text) for m in self.pattern.finditer(text, *part.span(1)))


# A license expression goes to the end of its line; a tag there ends at a blank, a bracket, a quote or a comment's end.
EXPRESSION = re.compile(r"spdx-license-identifier:([^\r\n]*)")
TAG_START, TAG_END = r"(?<![^\s()\[\]{}<>\"',;:])", r"(?=$|[\s()\[\]{}<>\"',;*]|-->)"


def _pattern(text: str) -> re.Pattern:
    text = text.replace("<ver>", r"(?:v(?:ersion)?\.?)").replace("<v>", r"(?:v(?:ersion)?\.? ?)")
    text = text.replace(" ?", "\x00").replace("[ -]", "[^0-9a-z]{1,3}")
    text = text.replace(" ", "[^0-9a-z]+").replace("\x00", "[^0-9a-z]*")
    return re.compile(rf"(?<![0-9a-z\x80-\U0010ffff])(?:{text})(?![0-9a-z\x80-\U0010ffff])")


def _lines() -> list[tuple[str, int, str, str]]:
    lines = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        lines.append((label, int(priority), keyword, pattern))
    for tag in TAGS.split():
        lines.append((tag, 8, "licen", rf"\"?licen[sc]e\"?\s{{0,4}}[:=]\s{{0,4}}[\"']{re.escape(tag)}[\"']"))
    for part, words in CC_PARTS.items():
        short = part.replace("-", "[ -]")
        lines.append((f"cc-{part}", 6, "cc", rf"cc[ -]{short}"))
        lines.append((f"cc-{part}", 6, "creative commons", rf"creative commons {words}(?: licen[sc]e)?"))
        for version in CC_VERSIONS:
            number = re.escape(version)
            lines.append((f"cc-{part}-{version}", 8, "cc", rf"cc[ -]{short}[ -]{number}"))
            lines.append((f"cc-{part}-{version}", 8, "creative commons", rf"creative commons {words} (?:licen[sc]e )?(?:<ver> )?{number}"))
            lines.append((f"cc-{part}-{version}", 9, "creativecommons.org", rf"creativecommons\.org/licenses/{part}/{number}"))
    return lines


def rules() -> list[Rule]:
    plain = [Rule(k, label, priority, keyword, _pattern(pattern)) for k, (label, priority, keyword, pattern) in enumerate(_lines())]
    return plain + [Rule(len(plain) + k, tag, 9, "spdx-license", re.compile(TAG_START + re.escape(tag) + TAG_END), EXPRESSION) for k, tag in enumerate(TAGS.split())]
