"""Licence signatures, written by hand as regexes over lower-case words joined by single spaces.

A signature is (label, tier, regex); tier 1 is the best evidence. Groups of signatures share a label.
NAMES gives the names that NOTICES put into the usual forms of a notice.
"""

from __future__ import annotations

import re

#: label: (tier, regex) of sentences, titles and identifiers.
SIGNATURES = {
    "0bsd": [(1, r"bsd zero clause license"), (1, r"zero clause bsd"), (2, r"bsd 0 clause")],
    "afl": [(1, r"licensed under the academic free license version [0-9] [0-9]"), (2, r"academic free license(?: version)? [0-9] [0-9]"), (3, r"afl(?: v)? [23] [01]")],
    "agpl": [
        (1, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"), (1, r"gnu affero general public license as published by the free software foundation"),
        (2, r"remote network interaction use with the gnu general public license"), (2, r"gnu affero general public license(?: version)? 3"), (3, r"affero gpl(?: v?3)?"), (3, r"agpl 3 0(?: only| or later)?"),
    ],
    "apache": [
        (1, r"licensed under the apache license version 2 0 the license"), (1, r"you may not use this file except in compliance with the license"), (1, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
        (1, r"see the license for the specific language governing permissions and limitations under the license"), (2, r"you may obtain a copy of the license at http www apache org licenses license 2 0"), (2, r"this product includes software developed by the apache software foundation"),
        (2, r"the names apache and apache software foundation must not be used to endorse or promote products"), (3, r"apache software license(?: version)? 1 [01]"), (3, r"apache 2 0 licen[sc]e"), (3, r"asl 2 0"), (4, r"apache license(?: version)? 2(?: 0)?"),
    ],
    "apsl": [(1, r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"), (2, r"apple public source license(?: version)? [12] [012]")],
    "artistic": [(1, r"the intent of this document is to state the conditions under which a package may be copied"), (1, r"the artistic license 2 0"), (2, r"under the same terms as perl itself"), (2, r"clarified artistic license"), (3, r"perl artistic license"), (4, r"artistic license(?: version)? [12] 0")],
    "beerware": [(1, r"if we meet some day and you think this stuff is worth it you can buy me a beer"), (1, r"the beer ?ware license(?: revision 42)?"), (3, r"beer ware license")],
    "bittorrent": [(2, r"bittorrent open source license(?: version)? 1 [01]")],
    "bsd": [
        (1, r"redistribution and use in source and binary forms with or without modification"), (2, r"may be used to endorse or promote products derived from this software"),
        (1, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"), (1, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        (1, r"redistributions in binary form must reproduce the above copyright notice"), (2, r"neither the name of (?:[a-z0-9]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software"), (2, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
        (2, r"all advertising materials mentioning features or use of this software must display the following acknowledgement"), (2, r"this software is provided by the (?:regents|copyright holders|author) and contributors as is"), (3, r"bsd style licen[sc]e"), (3, r"(?:new|modified|revised|simplified) bsd licen[sc]e"), (3, r"freebsd licen[sc]e"), (3, r"bsd [1234] clause(?: license| clear| patent)?"), (4, r"(?:two|three|four) clause bsd"),
    ],
    "bsl": [(1, r"boost software license version 1 0"), (1, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"), (2, r"distributed under the boost software license"), (3, r"bsl 1 0")],
    "busl": [(1, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"), (2, r"business source license(?: version)? 1 1"), (3, r"busl 1 1")],
    "caldera": [(2, r"caldera license"), (2, r"redistributions of source code and documentation must retain the above copyright notice(?: [a-z]+){0,12} caldera")],
    "cc0": [(1, r"the person who associated a work with this deed has dedicated the work to the public domain"), (1, r"creative commons(?: legal code)? cc0 1 0 universal"), (2, r"cc0 1 0(?: universal)?(?: public domain dedication)?"), (3, r"cc zero")],
    "cc-by": [(1, r"creative commons attribution(?: [0-9] [0-9])(?: international| unported| generic)?(?: public)? license"), (2, r"creative commons attribution [0-9] [0-9]"), (2, r"cc by(?: [0-9] [0-9])?"), (2, r"creativecommons org licenses by [0-9] [0-9]")],
    "cc-by-nc": [(1, r"(?:creative commons )?attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported| generic)?"), (1, r"cc by nc(?: [0-9] [0-9])?"), (1, r"creativecommons org licenses by nc [0-9] [0-9]")],
    "cc-by-nc-nd": [(1, r"attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [0-9] [0-9])?"), (1, r"cc by nc nd(?: [0-9] [0-9])?"), (1, r"creativecommons org licenses by nc nd [0-9] [0-9]")],
    "cc-by-nc-sa": [(1, r"attribution non ?commercial share ?alike(?: [0-9] [0-9])?"), (1, r"cc by nc sa(?: [0-9] [0-9])?"), (1, r"creativecommons org licenses by nc sa [0-9] [0-9]")],
    "cc-by-nd": [(1, r"(?:creative commons )?attribution no ?deriv(?:s|atives|ative works)(?: [0-9] [0-9])?"), (1, r"cc by nd(?: [0-9] [0-9])?"), (1, r"creativecommons org licenses by nd [0-9] [0-9]")],
    "cc-by-sa": [(1, r"(?:creative commons )?attribution share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)?"), (1, r"cc by sa(?: [0-9] [0-9])?"), (1, r"creativecommons org licenses by sa [0-9] [0-9]")],
    "cddl": [(1, r"the contents of this file are subject to the terms of the common development and distribution license"), (1, r"common development and distribution license(?: cddl)?(?: version)? 1 [01]"), (2, r"cddl 1 [01]"), (2, r"use is subject to license terms cddl")],
    "cecill": [(1, r"this software is governed by the cecill(?: [abc])? license under french law"), (2, r"cecill(?: [abc])? free software license agreement"), (2, r"licence de logiciel libre cecill"), (3, r"cecill [12] [01]")],
    "cpal": [(1, r"common public attribution license(?: version)? 1 0"), (3, r"cpal 1 0")],
    "cpl": [(1, r"the accompanying program is provided under the terms of this common public license"), (2, r"common public license(?: version)? 1 0"), (2, r"ibm public license(?: version)? 1 0")],
    "crypto": [(3, r"cryptix general license"), (3, r"openssl exception to the gpl")],
    "curl": [(1, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"), (3, r"curl licen[sc]e")],
    "ecl": [(1, r"educational community license version [12] 0"), (3, r"ecl 2 0")],
    "efl": [(2, r"eiffel forum license(?: version)? [12]")],
    "elastic": [(1, r"you may not provide the software to third parties as a hosted or managed service"), (2, r"elastic license 2 0"), (3, r"elv2")],
    "entessa": [(2, r"entessa public license")],
    "epl": [(1, r"the accompanying program is provided under the terms of this eclipse public license"), (1, r"this program and the accompanying materials are made available under the terms of the eclipse public license"), (2, r"eclipse public license(?: v| version)? ?[12] 0"), (2, r"eclipse distribution license(?: v| version)? ?1 0"), (3, r"epl [12] 0")],
    "eupl": [(1, r"licensed under the eupl(?: version)? 1 [012]"), (2, r"european union public licence(?: v| version)? ?1 [012]"), (3, r"eupl 1 [012]")],
    "fair": [(1, r"usage of the works is permitted provided that this instrument is retained with the works")],
    "frameworx": [(2, r"frameworx open license(?: version)? 1 0")],
    "freetype": [(1, r"portions of this software are copyright (?:[a-z0-9]+ ){0,6}the freetype project"), (2, r"the freetype project license")],
    "gfdl": [(1, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"), (2, r"gnu free documentation license(?: version)? 1 [0123]"), (2, r"with no invariant sections no front cover texts and no back cover texts"), (3, r"gfdl 1 [0123]")],
    "gpl": [
        (1, r"you can redistribute it and or modify it under the terms of the gnu general public license"), (1, r"gnu general public license as published by the free software foundation"), (1, r"either version [123](?: of the license)? or at your option any later version"),
        (1, r"you should have received a copy of the gnu general public license along with this program"), (1, r"this program is distributed in the hope that it will be useful but without any warranty"), (2, r"the gnu general public license is a free copyleft license for software"), (2, r"gnu general public license(?: v| version)? ?[123]"),
        (2, r"gnu gpl(?: v| version)? ?[123]"), (3, r"gpl [123] 0(?: only| or later)?"), (3, r"gplv1(?: or later| only)?"), (3, r"gplv2(?: or later| only)?"), (3, r"gplv3(?: or later| only)?"), (3, r"gpl compatible"), (4, r"module license gpl(?: v2)?"),
    ],
    "gpl-exception": [(1, r"as a special exception (?:[a-z]+ ){0,12}link(?:ing)? (?:[a-z]+ ){0,20}executable"), (2, r"gcc runtime library exception"), (2, r"with the classpath exception"), (2, r"autoconf exception"), (2, r"bison exception"), (2, r"font exception to the gpl")],
    "hpnd": [(1, r"historical permission notice and disclaimer"), (2, r"the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation")],
    "icu": [(1, r"icu license icu 1 8 1 and later"), (2, r"unicode license v3"), (2, r"unicode inc license agreement data files and software")],
    "ijg": [(1, r"this software is based in part on the work of the independent jpeg group")],
    "imagemagick": [(2, r"imagemagick license")],
    "info-zip": [(1, r"for the purposes of this copyright and license info zip is defined as the following set of individuals")],
    "intel": [(2, r"intel open source license"), (2, r"intel simplified software license")],
    "ipa": [(2, r"ipa font license agreement(?: v1 0)?")],
    "isc": [(1, r"permission to use copy modify and or distribute this software for any purpose with or without fee"), (1, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"), (1, r"the software is provided as is and the author disclaims all warranties with regard to this software"), (2, r"internet systems consortium license"), (3, r"isc style licen[sc]e")],
    "jasper": [(2, r"jasper license version 2 0")],
    "json": [(1, r"the software shall be used for good not evil")],
    "lgpl": [
        (1, r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"), (1, r"gnu (?:lesser|library) general public license as published by the free software foundation"), (1, r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
        (2, r"gnu (?:lesser|library) general public license(?: v| version)? ?[23](?: [01])?"), (3, r"lgpl [23] [01](?: only| or later)?"), (3, r"lgplv2(?: or later| only)?"), (3, r"lgplv21(?: or later| only)?"), (3, r"lgplv3(?: or later| only)?"), (3, r"gnu lgpl(?: v| version)? ?[23](?: 1)?"),
    ],
    "libpng": [(1, r"the origin of this source code must not be misrepresented"), (1, r"png reference library license version 2"), (2, r"libpng license")],
    "libtiff": [(1, r"the names of sam leffler and silicon graphics may not be used in any advertising or publicity")],
    "lppl": [(1, r"this work may be distributed and or modified under the conditions of the latex project public license"), (2, r"latex project public license(?: version)? 1 [0123]c?"), (3, r"lppl 1 3c?")],
    "llama": [(1, r"llama [234](?: [0-9])? community license agreement"), (3, r"llama [234](?: [0-9])? license")],
    "mit": [
        (1, r"permission is hereby granted free of charge to any person obtaining a copy"),
        (1, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"), (1, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        (1, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"), (2, r"merchantability fitness for a particular purpose and noninfringement"), (2, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
        (2, r"except as contained in this notice the names? of (?:[a-z0-9]+ ){1,12}shall not be used in advertising or otherwise to promote the sale"), (3, r"mit style licen[sc]e"), (3, r"expat licen[sc]e"), (3, r"x11 licen[sc]e"), (3, r"mit 0"), (4, r"mit or apache 2 0"),
    ],
    "mit-style": [(2, r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose")],
    "motosoto": [(2, r"motosoto open source license")],
    "mpl": [(1, r"this source code form is subject to the terms of the mozilla public license"), (1, r"the contents of this file are subject to the mozilla public license version 1 [01]"), (1, r"if a copy of the mpl was not distributed with this file you can obtain one at"), (2, r"mozilla public license(?: v| version)? ?[12] [01]"), (3, r"mpl [12] [01](?: no copyleft exception)?"), (3, r"mplv2(?: 0)?"), (2, r"mpl gpl lgpl tri license")],
    "ms-pl": [(1, r"microsoft public license(?: ms pl)?"), (2, r"ms pl")],
    "ms-rl": [(1, r"microsoft reciprocal license(?: ms rl)?"), (2, r"ms rl")],
    "mulan": [(1, r"mulan (?:psl|permissive software license) ?v?[12]"), (2, r"licensed under mulan")],
    "nasa": [(1, r"nasa open source agreement(?: version)? 1 3")],
    "naumen": [(2, r"naumen public license")],
    "ncsa": [(1, r"university of illinois(?: ncsa)? open source license"), (1, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction")],
    "netcdf": [(2, r"portions of this software were developed by the unidata program")],
    "nokia": [(2, r"nokia open source license")],
    "npl": [(1, r"netscape public license(?: version)? 1 [01]"), (3, r"npl 1 [01]")],
    "odbl": [(1, r"open data commons open database license"), (2, r"odbl(?: v?1 0)?"), (2, r"open data commons attribution license"), (2, r"open data commons public domain dedication and license")],
    "ofl": [(1, r"this font software is licensed under the sil open font license"), (2, r"sil open font license(?: version)? 1 [01]"), (3, r"ofl 1 1"), (2, r"the font software may not be sold by itself")],
    "openldap": [(1, r"the openldap public license(?: version)? 2 [0-9]")],
    "openssl": [(1, r"this product includes software developed by the openssl project for use in the openssl toolkit"), (1, r"this product includes cryptographic software written by eric young"), (2, r"openssl license"), (2, r"ssleay license")],
    "osl": [(1, r"licensed under the open software license version [123] [01]"), (2, r"open software license(?: v| version)? ?[123] [01]"), (3, r"osl 3 0")],
    "php": [(1, r"this source file is subject to version [23] [0-9]+ of the php license"), (1, r"this product includes php software freely available from"), (2, r"php license(?: version)? 3 0[01]?")],
    "polyform": [(1, r"polyform (?:noncommercial|shield|strict|perimeter|small business|free trial|internal use)(?: license)? 1 0 0")],
    "postgresql": [(1, r"postgresql is released under the postgresql license"), (1, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted")],
    "proprietary": [(2, r"proprietary and confidential"), (2, r"confidential and proprietary"), (2, r"unauthorized copying of this file via any medium is strictly prohibited"), (3, r"this software is the confidential and proprietary information of"), (3, r"no part of this (?:software|document|publication) may be reproduced"), (4, r"all rights reserved"), (3, r"end user license agreement"), (3, r"commercial license agreement"), (3, r"evaluation license")],
    "psf": [(1, r"python software foundation license version 2"), (1, r"psf license agreement for python"), (1, r"beopen com license agreement for python 2 0"), (1, r"cnri license agreement for python 1 6 1"), (1, r"cwi license agreement for python"), (3, r"psf 2 0"), (3, r"psfl")],
    "public-domain": [(1, r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"), (1, r"this (?:work|file|code|software|program) is (?:hereby )?(?:in|released into|placed in) the public domain"), (2, r"public domain dedication"), (2, r"waives all copyright"), (4, r"public domain"), (2, r"no copyright is claimed"), (2, r"not subject to copyright protection")],
    "qpl": [(1, r"the q public license(?: version)? 1 0"), (3, r"qpl 1 0")],
    "rail": [(1, r"creativeml open rail m(?: license)?"), (1, r"bigscience (?:open )?rail(?: m)?(?: license)?"), (3, r"openrail(?: m)?")],
    "ricoh": [(2, r"ricoh source code public license")],
    "rpl": [(1, r"reciprocal public license(?: version)? 1 [135]"), (3, r"rpl 1 [135]")],
    "ruby": [(1, r"you may make and give away verbatim copies of the source form of the software without restriction"), (2, r"distributed under the same terms as ruby"), (2, r"ruby license")],
    "sgi": [(1, r"sgi free software license b(?: version)? [12] [01]")],
    "sissl": [(1, r"sun industry standards source license(?: version)? 1 [12]"), (2, r"sissl")],
    "sleepycat": [(1, r"redistributions in any form must be accompanied by information on how to obtain complete source code"), (2, r"sleepycat license"), (2, r"sleepycat software")],
    "spl": [(1, r"sun public license(?: version)? 1 0")],
    "sspl": [(1, r"server side public license(?: v| version)? ?1"), (1, r"offering the program as a service"), (3, r"sspl(?: v?1)?")],
    "tcl": [(1, r"this software is copyrighted by the regents of the university of california sun microsystems"), (2, r"tcl tk license")],
    "unlicense": [(1, r"this is free and unencumbered software released into the public domain"), (1, r"anyone is free to copy modify publish use compile sell or distribute this software"), (2, r"for more information please refer to http unlicense org"), (3, r"the unlicense")],
    "upl": [(1, r"the universal permissive license(?: upl)?(?: version)? 1 0"), (3, r"upl 1 0")],
    "vim": [(1, r"i there are no restrictions on distributing unmodified copies of vim"), (2, r"vim license")],
    "vsl": [(1, r"vovida software license(?: version| v)? ?1 0")],
    "w3c": [(1, r"w3c software notice and license"), (1, r"w3c software and document notice and license"), (2, r"w3c document license"), (3, r"w3c licen[sc]e")],
    "watcom": [(1, r"sybase open watcom public license(?: version)? 1 0")],
    "wtfpl": [(1, r"do what the fuck you want to public license"), (1, r"you just do what the fuck you want to"), (3, r"wtfpl(?: version)?(?: 2)?")],
    "wxwindows": [(1, r"wxwindows library licen[sc]e(?: version)?(?: 3 1)?"), (3, r"wxwidgets licen[sc]e")],
    "xfree86": [(1, r"this product includes software developed by the xfree86 project"), (2, r"xfree86 license(?: 1 1)?")],
    "xnet": [(2, r"x net license")],
    "zend": [(1, r"this product includes the zend engine freely available at"), (2, r"zend engine license")],
    "zlib": [(1, r"the origin of this software must not be misrepresented"), (1, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"), (1, r"altered source versions must be plainly marked as such"), (2, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"), (2, r"this notice may not be removed or altered from any source distribution"), (3, r"zlib libpng license"), (3, r"zlib licen[sc]e")],
    "zpl": [(1, r"zope public license(?: zpl)?(?: version)? [12] [01]"), (3, r"zpl 2 [01]")],
}
#: label: names as they stand in notices, in whole words.
NAMES = {
    "0bsd": ["0bsd"], "afl": ["academic free"], "agpl": ["agpl", "agplv3", "agpl3", "affero general public"], "apache": ["apache", "apache software", "apache2"], "apsl": ["apple public source"], "artistic": ["artistic"],
    "beerware": ["beerware"], "bsd": ["bsd", "bsd2", "bsd3"], "bsl": ["boost software", "boost"], "busl": ["business source"], "cc0": ["cc0"], "cc-by": ["creative commons attribution"], "cddl": ["cddl", "common development and distribution"],
    "cecill": ["cecill"], "cpl": ["common public"], "ecl": ["educational community"], "elastic": ["elastic"], "epl": ["eclipse public", "epl"], "eupl": ["eupl", "european union public"], "gfdl": ["free documentation", "gfdl"],
    "gpl": ["gpl", "gplv1", "gplv2", "gplv3", "gpl1", "gpl2", "gpl3", "general public"], "hpnd": ["hpnd"], "isc": ["isc"], "lgpl": ["lgpl", "lgplv2", "lgplv3", "lgpl2", "lgpl3", "lesser general public", "library general public"],
    "mit": ["mit", "mit x11", "expat"], "mpl": ["mozilla public", "mpl"], "ms-pl": ["microsoft public"], "ms-rl": ["microsoft reciprocal"], "ncsa": ["university of illinois", "ncsa"], "odbl": ["open database"], "ofl": ["open font", "sil open font"],
    "osl": ["open software"], "php": ["php"], "postgresql": ["postgresql"], "psf": ["python", "python software foundation"], "qpl": ["qpl", "q public"], "ruby": ["ruby"], "sspl": ["server side public"], "unlicense": ["unlicense"],
    "upl": ["universal permissive"], "vim": ["vim"], "w3c": ["w3c", "w3c software"], "wtfpl": ["wtfpl"], "zlib": ["zlib", "zlib libpng"], "zpl": ["zope public"],
}
_VERSION = r"(?: v(?:ersion)? ?[0-9]+(?: [0-9]+)*)?"
#: tier, how a name stands in a notice.
NOTICES = [
    (1, r"spdx license identifier {name}(?: license)?(?: [0-9]+)*(?: (?:only|or later))?"),
    (2, r"(?:licensed|released|distributed|available|published|provided|issued) (?:[a-z]+ ){{0,3}}(?:under|with) (?:the )?(?:terms of the )?(?:gnu )?{name}(?: licen[sc]e)?" + _VERSION),
    (3, r"(?:subject to|governed by|terms of|terms and conditions of|covered by|conditions of) (?:the )?(?:gnu )?{name}(?: licen[sc]e)?" + _VERSION),
    (4, r"licen[sc]e (?:the )?(?:gnu )?{name}" + _VERSION),
    (5, r"(?:gnu )?{name} licen[sc]e" + _VERSION),
    (5, r"{name} licensed"),
]
#: Words that nearly every text has: they tell nothing.
STOP = frozenset("a an and are as at be by for from in is it of on or that the this to was will".split())
#: Words that are in most signatures or most texts: a gate takes another word where there is one.
COMMON = frozenset("a an and any are as at be by can copy covered distributed document file files for foundation free from general identifier in is it license licence licensed may modify must not notice of on open or org other project product public release released software source spdx terms that the this to under use used version was will with work you your".split())


def _items(regex: str) -> list[tuple[str, bool]]:
    """The parts outside of all groups: (a character, a group or a class; whether it may be absent)."""
    out, at = [], 0
    while at < len(regex):
        end = at + 1
        if regex[at] == "(":
            depth = 1
            while depth:
                depth += (regex[end] == "(") - (regex[end] == ")")
                end += 1
        elif regex[at] == "[":
            end = regex.index("]", at) + 1
        part = regex[at:end]
        at = end + len(found := re.match(r"[?+*]|\{[0-9,]+\}|", regex[end:]).group())
        out.append((part if found != "+" else f"[{part}]", found[:1] in ("?", "*") or found.startswith("{0")))
    return out


def clauses(regex: str) -> list[tuple[str, ...]]:
    """For each whole word that a match holds outside of optional parts: the words it can be."""
    items = _items(regex)

    def cut_off(at: int, step: int) -> bool:
        """Whether a space or the match's end is next, whichever optional parts are absent."""
        while 0 <= at < len(items):
            part, optional = items[at]
            if not (part == " " or part.startswith("(?:") and (part.startswith("(?: ") if step > 0 else part.endswith(" )"))):
                return False
            if not optional:
                return True
            at += step
        return True

    def choices(part: str, optional: bool) -> list[str] | None:
        if optional:
            return None
        if re.fullmatch(r"[a-z0-9]", part):
            return [part]
        if re.fullmatch(r"\[[a-z0-9]{2,4}\]", part):
            return list(part[1:-1])
        return part[3:-1].split("|") if re.fullmatch(r"\(\?:[a-z0-9]+(?:\|[a-z0-9]+)*\)", part) else None

    out, at = [], 0
    while at < len(items):
        end, some = at, [""]
        while end < len(items) and (more := choices(*items[end])):
            some = [x + y for x in some for y in more]
            end += 1
        if end > at and cut_off(end, 1) and cut_off(at - 1, -1):
            out.append(tuple(sorted(set(some))))
        at = max(end, at + 1)
    return out


def gate(regex: str) -> tuple[str, list[tuple[str, ...]]]:
    """(A word that stands in every match: the longest that is not common, if there is one; sets of words of
    each of which every match has one). A text without these words needs no look at the signature."""
    found = clauses(regex)
    single = [c[0] for c in found if len(c) == 1]
    if not single:
        raise ValueError(f"no one word stands in every match of {regex!r}")
    word = max(single, key=lambda w: (w not in COMMON, len(w)))
    return word, sorted({c for c in found if word not in c and not STOP & set(c)})


def rules() -> list[tuple[str, str, list[tuple[str, ...]], int, str]]:
    """(label, gate, needs, tier, regex) of every rule, best tiers first."""
    made = [(label, tier, regex) for label, some in SIGNATURES.items() for tier, regex in some]
    made += [(label, tier, notice.format(name=name)) for label, names in NAMES.items() for name in names for tier, notice in NOTICES]
    return sorted(((label, *gate(regex), tier, regex) for label, tier, regex in made), key=lambda r: r[3])
