"""Licence sentences, names and rules for license_scan.

SENTENCES: one sentence a line, "id: words" as they stand after normalisation (lower case, words of letters and
digits only, "licence" as "license", and the thing that a notice is about as "it": "this program" is "this it").
[a|b] are alternatives and may be empty; ... stands for any words. The wording is that of the public licences.
"""

from __future__ import annotations

import itertools
import re

SENTENCES = """
mit-grant: permission is hereby granted free of charge to any person obtaining a copy of this it and associated documentation files ...
mit-notice: the above copyright notice and this permission notice [including the next paragraph|] shall be included in all copies or substantial portions of the software
as-is: the software is provided as is without warranty of any kind ...
as-is-author: the software is provided as is and the author disclaims all warranties ...
no-liability: in no event shall the [author|authors|copyright holders|x consortium] ... liable for any ...
apache-header: [this it is|] licensed under the apache license version 2 0 [the license|] you may not use this it except in compliance with the license
apache-grant: [this it is|] licensed under the apache license version 2 0 the license
apache-compliance: you may not use this it except in compliance with the license
apache-copy: you may obtain a copy of the license at
apache-copy: you may obtain a copy of the license at ...
apache-basis: unless required by applicable law or agreed to in writing [software|this it] distributed under the license is distributed on an as is basis ...
apache-limits: see the license for the specific language governing permissions and limitations under the license
gnu-hope: this it is distributed in the hope that it will be useful but without any warranty ...
gnu-hope: this it is distributed in the hope that it will be useful but without any warranty
gnu-implied: without even the implied warranty of merchantability or fitness for a particular purpose
gnu-copy: you should have received a copy of the gnu ... public license along with ...
gnu-url: if not see ... licenses ...
bsd-redistribution: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-redistribution: redistribution and use in source and binary forms with or without modification are permitted ... provided that the following conditions are met
bsd-source: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-binary: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-ad: all advertising materials mentioning features or use of this it must display the following acknowledgement ...
bsd-endorse: neither the name of ... may be used to endorse or promote products derived from this it without specific prior written permission
bsd-disclaimer: this it is provided by ... as is and any express or implied warranties ... are disclaimed
bsd-liability: in no event shall ... be liable for any direct indirect incidental special exemplary or consequential damages ...
mpl2-subject: this source code form is subject to the terms of the mozilla public license [v|version] 2 0
mpl2-copy: if a copy of the mpl was not distributed with this it you can obtain one at ...
mpl1-subject: the contents of this it are subject to the mozilla public license version 1 1 ...
cddl-subject: the contents of this it are subject to the terms of the common development and distribution license ...
epl1-available: this it and the accompanying materials are made available under the terms of the eclipse public license [v|version] 1 0 ...
epl2-available: this it and the accompanying materials are made available under the terms of the eclipse public license [v|version|] 2 0 ...
epl2-available: this it and the accompanying materials are made available under the terms of the eclipse public license [v|version|] 2 0
bsl-header: distributed under the boost software license version 1 0 ...
bsl-header: distributed under the boost software license version 1 0
bsl-grant: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license ...
zlib-warranty: this it is provided as is without any express or implied warranty
zlib-liability: in no event will the authors be held liable for any damages arising from the use of this it
zlib-grant: permission is granted to anyone to use this it for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
zlib-origin: the origin of this it must not be misrepresented you must not claim that you wrote the original software
zlib-origin: the origin of this it must not be misrepresented
zlib-altered: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib-notice: this notice may not be removed or altered from any source distribution
isc-grant: permission to use copy modify and [or|] distribute this it for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
zero-grant: permission to use copy modify and [or|] distribute this it for any purpose with or without fee is hereby granted
postgresql-grant: permission to use copy modify and distribute this it and its documentation for any purpose without fee and without a written agreement is hereby granted ...
unlicense-free: this is free and unencumbered software released into the public domain
unlicense-anyone: anyone is free to copy modify publish use compile sell or distribute this it ...
public-domain: [this it is|this it has been|] [released into|placed in|dedicated to|in] the public domain
cc0-dedicated: to the extent possible under law ... [have|has] [dedicated|waived] all copyright and related [and|or] neighboring rights to ...
ofl-licensed: this it is licensed under the sil open font license version 1 1
wtfpl-do: you just do what the fuck you want to
wtfpl-copy: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
beerware: as long as you retain this notice you can do whatever you want with this stuff
mspl-governs: this license governs use of the accompanying software
eupl-licensed: licensed under the eupl version 1 2 ...
all-rights: all rights reserved
all-rights: copyright ... all rights reserved
confidential: this it is [confidential and proprietary|proprietary and confidential] ...
no-copying: unauthorized copying of this it via any medium is strictly prohibited ...
"""

#: A notice is about this ...
THINGS = "program library software file package project work code module application tool script font document plugin dataset repository product material component framework website book article".split()

#: Names as they stand after normalisation, without "the", "license" and "version".
NAMES = {
    "MIT": ["mit", "mit mit", "expat", "mit expat", "expat mit", "mit x11"], "X11": ["x11"], "MIT-0": ["mit 0", "mit no attribution"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache software 2 0", "apache 2 0 apache 2 0"], "Apache-1.1": ["apache 1 1", "apache software 1 1"], "Apache": ["apache", "apache software"],
    "BSD": ["bsd"], "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "bsd 2"], "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd 3", "bsd 3 clause new or revised"], "BSD-4-Clause": ["bsd 4 clause", "4 clause bsd", "original bsd"], "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "MPL-2.0": ["mozilla public 2 0", "mpl 2 0", "mpl 2", "mozilla public 2"], "MPL-1.1": ["mozilla public 1 1", "mpl 1 1"], "MPL": ["mozilla public", "mpl"],
    "EPL-2.0": ["eclipse public 2 0", "epl 2 0"], "EPL-1.0": ["eclipse public 1 0", "epl 1 0"], "ISC": ["isc"], "Zlib": ["zlib", "zlib libpng"], "BSL-1.0": ["boost software 1 0", "bsl 1 0", "boost software", "boost"],
    "Unlicense": ["unlicense"], "CDDL-1.0": ["common development and distribution 1 0", "cddl 1 0", "cddl"], "Artistic-2.0": ["artistic 2 0"], "Artistic-1.0": ["artistic", "artistic 1 0"], "PSF-2.0": ["python software foundation", "psf", "psf 2"],
    "PostgreSQL": ["postgresql"], "OFL-1.1": ["sil open font 1 1", "ofl 1 1", "open font", "sil open font"], "EUPL-1.2": ["eupl 1 2", "european union public 1 2", "european union public 1 2 eupl"], "WTFPL": ["wtfpl", "do what the fuck you want to public"], "MS-PL": ["ms pl", "microsoft public"], "NCSA": ["ncsa", "university of illinois ncsa open source"],
    "ODbL-1.0": ["odbl", "open database", "odbl 1 0"], "BUSL-1.1": ["business source 1 1", "busl 1 1"], "SSPL-1.0": ["server side public", "sspl", "server side public 1"], "Elastic-2.0": ["elastic 2 0"], "GFDL-1.3": ["gnu free documentation 1 3", "gfdl 1 3"], "GFDL": ["gnu free documentation", "gfdl"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons zero 1 0 universal", "creative commons cc0", "creative commons zero 1 0", "cc zero"],
}

GNU = {"GPL": "gnu general public|general public|gnu gpl|gpl", "LGPL": "gnu lesser general public|gnu library general public|lesser general public|gnu lgpl|lgpl", "AGPL": "gnu affero general public|affero general public|gnu agpl|agpl"}
GNU_WORDS = {"GPL": ["general"], "LGPL": ["lesser general", "library general"], "AGPL": ["affero general"]}
GNU_VERSIONS = {"": [""], "1.0": ["1", "1 0"], "2.0": ["2", "2 0"], "2.1": ["2 1"], "3.0": ["3", "3 0"]}
GNU_LATER = {"": [""], "-or-later": ["or later", "or any later", "or at your option any later", "or newer", "or above"], "-only": ["only"]}
CC_PARTS = {"SA": ["sa", "sharealike", "share alike"], "NC": ["nc", "noncommercial", "non commercial"], "ND": ["nd", "noderivatives", "no derivatives", "noderivs"]}

#: Licences named by one sentence or more in a row, with the words (ids) in their order.
RULES = """
MIT: mit-grant mit-notice as-is no-liability
MIT: mit-grant mit-notice as-is
MIT: mit-grant mit-notice
MIT-0: mit-grant as-is
Apache-2.0: apache-header apache-copy apache-basis apache-limits
Apache-2.0: apache-grant apache-compliance apache-copy apache-basis apache-limits
Apache-2.0: apache-header apache-copy
Apache-2.0: under:Apache-2.0 apache-compliance apache-copy apache-basis apache-limits
Apache-2.0: under:Apache-2.0 apache-compliance apache-copy
Apache-2.0: apache-header
Apache-2.0: apache-grant
BSD-4-Clause: bsd-redistribution bsd-source bsd-binary bsd-ad bsd-endorse bsd-disclaimer bsd-liability
BSD-4-Clause: bsd-redistribution bsd-source bsd-binary bsd-ad bsd-endorse
BSD-3-Clause: bsd-redistribution bsd-source bsd-binary bsd-endorse bsd-disclaimer bsd-liability
BSD-3-Clause: bsd-redistribution bsd-source bsd-binary bsd-endorse
BSD-2-Clause: bsd-redistribution bsd-source bsd-binary bsd-disclaimer bsd-liability
BSD-2-Clause: bsd-redistribution bsd-source bsd-binary
MPL-2.0: mpl2-subject mpl2-copy
MPL-2.0: mpl2-subject
MPL-1.1: mpl1-subject
CDDL-1.0: cddl-subject
EPL-1.0: epl1-available
EPL-2.0: epl2-available
BSL-1.0: bsl-grant
BSL-1.0: bsl-header
Zlib: zlib-warranty zlib-liability zlib-grant zlib-origin zlib-altered zlib-notice
Zlib: zlib-grant zlib-origin zlib-altered zlib-notice
Zlib: zlib-grant zlib-origin
ISC: isc-grant as-is-author
ISC: isc-grant
0BSD: zero-grant as-is-author
0BSD: zero-grant
PostgreSQL: postgresql-grant
Unlicense: unlicense-free unlicense-anyone
Unlicense: unlicense-free
Public-Domain: public-domain
CC0-1.0: cc0-dedicated
OFL-1.1: ofl-licensed
WTFPL: wtfpl-copy wtfpl-do
WTFPL: wtfpl-do
Beerware: beerware
MS-PL: mspl-governs
EUPL-1.2: eupl-licensed
Proprietary: all-rights
Proprietary: confidential
Proprietary: no-copying
"""

#: Licences that count only in a text that names no other.
WEAK = {"Proprietary"}


def expanded(pattern: str) -> list[str]:
    """All wordings of a pattern with [alternatives]."""
    parts = [p[1:-1].split("|") if p.startswith("[") else [p] for p in re.split(r"(\[[^]]*\])", pattern)]
    return [" ".join("".join(x).split()) for x in itertools.product(*parts)]


def known_sentences() -> list[tuple[str, str]]:
    """(id, words) of every wording, with those of the GNU notices."""
    found = [(line.split(": ", 1)[0], w) for line in SENTENCES.strip().splitlines() for w in expanded(line.split(": ", 1)[1])]
    start = "[this it is free software|] you can redistribute it and or modify it under the terms of"
    for kind, names in GNU_WORDS.items():
        for name in names:
            found += [(f"gnu-details:{kind}", w) for w in expanded(f"see the gnu {name} public license [version 2|version 3|] for more details")]
            found += [(f"gnu:{kind}", w) for w in expanded(f"{start} the gnu {name} public license as published by the free software foundation")]
            for number, spelt in GNU_VERSIONS.items():
                for v in spelt if number else []:
                    same = [f"the gnu {name} public license as published by the free software foundation [either|] version {v} of the license", f"version {v} of the gnu {name} public license as published by the free software foundation", f"the gnu {name} public license version {v} as published by the free software foundation"]
                    for s in same:
                        found += [(f"gnu:{kind}-{number}", w) for w in expanded(f"{start} {s}")]
                        found += [(f"gnu:{kind}-{number}-or-later", w) for w in expanded(f"{start} {s} or at your option any later version")]
    return found


def known_names() -> dict[str, str]:
    """Licence by name, with the versions of GNU and Creative Commons licences."""
    out = {name: licence for licence, names in NAMES.items() for name in names}
    for kind, names in GNU.items():
        for name, (number, spelt), (later, words) in itertools.product(names.split("|"), GNU_VERSIONS.items(), GNU_LATER.items()):
            for v, w in itertools.product(spelt, words):
                if number or not later:
                    out[" ".join(f"{name} {v} {w}".split())] = f"{kind}-{number}{later}".rstrip("-")
    for parts in ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND")):
        for lead, *spelt in itertools.product(["cc by", "creative commons attribution", "creative commons by"], *(CC_PARTS[p] for p in parts)):
            for v, tail in itertools.product(["", "1 0", "2 0", "2 5", "3 0", "4 0"], ["", "international", "unported", "generic", "deed"]):
                out[" ".join(f"{lead} {' '.join(spelt)} {v} {tail}".split())] = "-".join(["CC-BY", *parts, *([v.replace(" ", ".")] if v else [])])
    return out


def known_rules() -> list[tuple[str, tuple[str, ...]]]:
    """(licence, ids), longest first."""
    found = [(line.split(": ")[0], tuple(line.split(": ")[1].split())) for line in RULES.strip().splitlines()]
    for kind in GNU_WORDS:
        for licence in [kind, *(f"{kind}-{n}{later}" for n in GNU_VERSIONS if n for later in ("", "-or-later"))]:
            details = f"gnu-details:{kind}"
            found += [(licence, (f"gnu:{licence}", *rest)) for rest in (("gnu-hope", details, "gnu-copy", "gnu-url"), ("gnu-hope", details, "gnu-copy"), ("gnu-hope", details), ("gnu-hope", "gnu-implied", details), ("gnu-hope",), ())]
    return sorted(found, key=lambda r: -len(r[1]))
