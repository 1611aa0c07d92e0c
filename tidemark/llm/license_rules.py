"""The ordered signature rules of the license scan, each written by hand with an example that it must find.

A rule is one line: label, weight, regex over lower-case words joined by one space, example. L stands for licen[sc]e, V for an
optional "version" or "v". The tables are in order of priority: tags, texts of licenses and grants, names, notices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from re import _constants as kind
from re import _parser as parser

TAGS = """
apache-1.0    ; 1 ; spdx L identifier apache 1 0                                ; spdx license identifier apache 1 0
apache-1.1    ; 1 ; spdx L identifier apache 1 1                                ; spdx license identifier apache 1 1
apache-2.0    ; 1 ; spdx L identifier apache 2 0(?: with llvm exception)?       ; spdx license identifier apache 2 0 with llvm exception
mit           ; 1 ; spdx L identifier mit                                       ; spdx license identifier mit
mit-0         ; 1 ; spdx L identifier mit 0                                     ; spdx license identifier mit 0
isc           ; 1 ; spdx L identifier isc                                       ; spdx license identifier isc
0bsd          ; 1 ; spdx L identifier 0bsd                                      ; spdx license identifier 0bsd
bsd-2-clause  ; 1 ; spdx L identifier bsd 2 clause(?: patent| views)?           ; spdx license identifier bsd 2 clause
bsd-3-clause  ; 1 ; spdx L identifier bsd 3 clause(?: clear| lbnl)?             ; spdx license identifier bsd 3 clause
bsd-4-clause  ; 1 ; spdx L identifier bsd 4 clause(?: uc)?                      ; spdx license identifier bsd 4 clause uc
gpl-1.0       ; 1 ; spdx L identifier gpl 1 0(?: only| or later)?               ; spdx license identifier gpl 1 0 or later
gpl-2.0       ; 1 ; spdx L identifier gpl 2 0(?: only| or later)?               ; spdx license identifier gpl 2 0 only
gpl-2.0-with-classpath ; 1 ; spdx L identifier gpl 2 0(?: only)? with classpath exception(?: 2 0)? ; spdx license identifier gpl 2 0 only with classpath exception 2 0
gpl-2.0-with-linux-note ; 1 ; spdx L identifier gpl 2 0(?: only| or later)? with linux syscall note ; spdx license identifier gpl 2 0 with linux syscall note
gpl-3.0       ; 1 ; spdx L identifier gpl 3 0(?: only| or later)?               ; spdx license identifier gpl 3 0
lgpl-2.0      ; 1 ; spdx L identifier lgpl 2 0(?: only| or later)?              ; spdx license identifier lgpl 2 0 only
lgpl-2.1      ; 1 ; spdx L identifier lgpl 2 1(?: only| or later)?              ; spdx license identifier lgpl 2 1 or later
lgpl-3.0      ; 1 ; spdx L identifier lgpl 3 0(?: only| or later)?              ; spdx license identifier lgpl 3 0 only
agpl-3.0      ; 1 ; spdx L identifier agpl 3 0(?: only| or later)?              ; spdx license identifier agpl 3 0 or later
gfdl-1.3      ; 1 ; spdx L identifier gfdl 1 3(?: only| or later)?              ; spdx license identifier gfdl 1 3 or later
mpl-1.1       ; 1 ; spdx L identifier mpl 1 1                                   ; spdx license identifier mpl 1 1
mpl-2.0       ; 1 ; spdx L identifier mpl 2 0(?: no copyleft exception)?        ; spdx license identifier mpl 2 0
epl-1.0       ; 1 ; spdx L identifier epl 1 0                                   ; spdx license identifier epl 1 0
epl-2.0       ; 1 ; spdx L identifier epl 2 0                                   ; spdx license identifier epl 2 0
cddl-1.0      ; 1 ; spdx L identifier cddl 1 [01]                               ; spdx license identifier cddl 1 0
eupl-1.2      ; 1 ; spdx L identifier eupl 1 2                                  ; spdx license identifier eupl 1 2
artistic-2.0  ; 1 ; spdx L identifier artistic 2 0                              ; spdx license identifier artistic 2 0
boost-1.0     ; 1 ; spdx L identifier bsl 1 0                                   ; spdx license identifier bsl 1 0
busl-1.1      ; 1 ; spdx L identifier busl 1 1                                  ; spdx license identifier busl 1 1
zlib          ; 1 ; spdx L identifier zlib                                      ; spdx license identifier zlib
unlicense     ; 1 ; spdx L identifier unlicense                                 ; spdx license identifier unlicense
wtfpl         ; 1 ; spdx L identifier wtfpl                                     ; spdx license identifier wtfpl
ofl-1.1       ; 1 ; spdx L identifier ofl 1 1                                   ; spdx license identifier ofl 1 1
python-2.0    ; 1 ; spdx L identifier (?:python|psf) 2 0                        ; spdx license identifier psf 2 0
cc0-1.0       ; 1 ; spdx L identifier cc0 1 0                                   ; spdx license identifier cc0 1 0
cc-by-3.0     ; 1 ; spdx L identifier cc by 3 0                                 ; spdx license identifier cc by 3 0
cc-by-4.0     ; 1 ; spdx L identifier cc by 4 0                                 ; spdx license identifier cc by 4 0
cc-by-sa      ; 1 ; spdx L identifier cc by sa [1234] [05]                      ; spdx license identifier cc by sa 4 0
cc-by-nc      ; 1 ; spdx L identifier cc by nc [1234] [05]                      ; spdx license identifier cc by nc 4 0
cc-by-nd      ; 1 ; spdx L identifier cc by nd [1234] [05]                      ; spdx license identifier cc by nd 3 0
cc-by-nc-sa   ; 1 ; spdx L identifier cc by nc sa [1234] [05]                   ; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd   ; 1 ; spdx L identifier cc by nc nd [1234] [05]                   ; spdx license identifier cc by nc nd 4 0
odbl-1.0      ; 1 ; spdx L identifier odbl 1 0                                  ; spdx license identifier odbl 1 0
other         ; 0.9 ; spdx L identifier [^ ]+                                   ; spdx license identifier something
"""

TEXTS = """
mit           ; 0.95 ; permission is hereby granted free of charge to any person obtaining a copy ; permission is hereby granted free of charge to any person obtaining a copy
mit           ; 0.9 ; the above copyright notice and this permission notice shall be included in all copies or substantial portions ; the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit           ; 0.9 ; (?:licensed|released|available|distributed|published) under (?:the )?(?:terms of )?(?:the )?mit L ; it is released under the terms of the mit license
mit           ; 0.8 ; mit L (?:see|copyright) [^ ]+                              ; mit license see license
mit-0         ; 0.9 ; mit no attribution(?: L)?                                  ; mit no attribution
isc           ; 0.95 ; permission to use copy modify and (?:or )?distribute this software for any purpose ; permission to use copy modify and or distribute this software for any purpose
isc           ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?isc L ; licensed under the isc license
bsd           ; 0.9 ; redistribution and use in source and binary forms          ; redistribution and use in source and binary forms
bsd           ; 0.85 ; redistributions of source code must retain the above copyright notice ; redistributions of source code must retain the above copyright notice
bsd           ; 0.85 ; redistributions in binary form must reproduce the above copyright notice ; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause  ; 0.9 ; neither the name of [^.]{1,80} nor the names of (?:its|any|the) contributors ; neither the name of the university nor the names of its contributors
bsd-4-clause  ; 0.9 ; all advertising materials mentioning features or use of this software must display ; all advertising materials mentioning features or use of this software must display
bsd           ; 0.9 ; (?:licensed|released|available|distributed|governed) (?:under|by) (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? L ; use is governed by a bsd style license
bsd-2-clause  ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) L ; released under the 2 clause bsd license
bsd-3-clause  ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd) L ; available under the new bsd license
apache-2.0    ; 0.95 ; licensed under the apache L version 2 0                   ; licensed under the apache license version 2 0
apache-2.0    ; 0.9 ; you may not use this file except in compliance with the L  ; you may not use this file except in compliance with the license
apache-2.0    ; 0.9 ; you may obtain a copy of the L at http www apache org licenses L 2 0 ; you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0    ; 0.85 ; (?:released|available|distributed|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? L(?: V2(?: 0)?)? ; available under the terms of the apache license 2 0
apache-1.1    ; 0.9 ; this product includes software developed by the apache (?:software foundation|group) ; this product includes software developed by the apache software foundation
gpl           ; 0.9 ; free software you can redistribute it and or modify it under the terms of the gnu general public L ; free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl           ; 0.8 ; free software you can redistribute it and or modify it     ; this is free software you can redistribute it and or modify it
gpl           ; 0.8 ; you should have received a copy of the gnu general public L ; you should have received a copy of the gnu general public license
gpl           ; 0.85 ; (?:licensed|released|available|distributed|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public L) ; licensed under the gnu gpl
gpl-2.0       ; 0.95 ; (?:gnu )?general public L as published by the free software foundation (?:either )?version 2 ; gnu general public license as published by the free software foundation either version 2
gpl-3.0       ; 0.95 ; (?:gnu )?general public L as published by the free software foundation (?:either )?version 3 ; general public license as published by the free software foundation version 3
gpl-2.0       ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl ?v?2|gplv2|general public L V2)(?: 0)?(?: only| or later)? ; distributed under the terms of the gnu gpl v2
gpl-3.0       ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl ?v?3|gplv3|general public L V3)(?: 0)?(?: only| or later)? ; released under the gnu general public license version 3
gpl           ; 0.7 ; either version [123] (?:of the L )?or (?:\\(?at your option\\)? )any later version ; either version 2 of the license or at your option any later version
lgpl          ; 0.9 ; redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public L ; redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl          ; 0.85 ; you should have received a copy of the gnu (?:lesser|library) general public L ; you should have received a copy of the gnu library general public license
lgpl          ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public L) ; licensed under the lgpl
agpl-3.0      ; 0.9 ; under the terms of the gnu affero general public L         ; modify it under the terms of the gnu affero general public license
agpl-3.0      ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:gnu )?(?:agpl|agplv3|agpl v?3)(?: 0)? ; licensed under the agpl v3
gpl-exception ; 0.85 ; as a special exception (?:the copyright holders|you may) [^.]{1,60} ; as a special exception the copyright holders give you permission
mpl-2.0       ; 0.95 ; this source code form is subject to the terms of the mozilla public L(?: v 2 0)? ; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1       ; 0.95 ; the contents of this file are subject to the mozilla public L version 1 1 ; the contents of this file are subject to the mozilla public license version 1 1
mpl           ; 0.9 ; (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public L) ; available under the mozilla public license
epl-1.0       ; 0.9 ; made available under the terms of the eclipse public L V1 0 ; made available under the terms of the eclipse public license v1 0
epl-2.0       ; 0.9 ; made available under the terms of the eclipse public L V2(?: 0)? ; made available under the terms of the eclipse public license 2 0
cddl-1.0      ; 0.95 ; subject to the terms of the common development and distribution L ; subject to the terms of the common development and distribution license
artistic      ; 0.9 ; (?:licensed|released|available|distributed|modify it) under (?:the )?(?:same terms as perl(?: itself)?|terms of the artistic L) ; you can redistribute it and modify it under the same terms as perl itself
zlib          ; 0.95 ; this software is provided as is without any express or implied warranty in no event will the authors ; this software is provided as is without any express or implied warranty in no event will the authors
zlib          ; 0.9 ; altered source versions must be plainly marked as such     ; altered source versions must be plainly marked as such
boost-1.0     ; 0.95 ; distributed under the boost software L(?: version 1 0)?   ; distributed under the boost software license version 1 0
unlicense     ; 0.95 ; this is free and unencumbered software released into the public domain ; this is free and unencumbered software released into the public domain
wtfpl         ; 0.95 ; do what the fuck you want to(?: public L)?                ; you just do what the fuck you want to
ofl-1.1       ; 0.95 ; this font software is licensed under the sil open font L   ; this font software is licensed under the sil open font license
cc0-1.0       ; 0.95 ; to the extent possible under law [^.]{1,60} waived all copyright ; to the extent possible under law the author has waived all copyright
cc0-1.0       ; 0.9 ; (?:dedicated|released) (?:to|into) the public domain (?:under|via|using) cc0 ; dedicated to the public domain under cc0
cc-by-sa      ; 0.9 ; (?:licensed|released|available|published) under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])? ; licensed under a creative commons attribution sharealike 4 0
cc-by-nc      ; 0.9 ; (?:licensed|released|available|published) under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])? ; published under the creative commons attribution noncommercial 4 0
cc-by-nd      ; 0.9 ; (?:licensed|released|available|published) under (?:a |the )?creative commons attribution no ?derivatives(?: [1-4] [05])? ; available under a creative commons attribution noderivatives 4 0
cc-by         ; 0.85 ; (?:licensed|released|available|published) under (?:a |the )?creative commons attribution(?: [1-4] [05])? ; licensed under a creative commons attribution 4 0
cc-by         ; 0.85 ; (?:licensed|released|available|published) under (?:a |the )?cc by ; text is available under cc by
cc            ; 0.8 ; (?:licensed|released|available|published) under (?:a |the )?creative commons L ; published under a creative commons license
odbl-1.0      ; 0.9 ; (?:licensed|released|available|made available) under the open database L ; is made available under the open database license
pddl-1.0      ; 0.9 ; (?:licensed|released|available) under the (?:odc )?public domain dedication and L ; available under the public domain dedication and license
busl-1.1      ; 0.9 ; use of this software is governed by the business source L  ; use of this software is governed by the business source license
sspl-1.0      ; 0.9 ; (?:licensed|available|released) under (?:the )?(?:terms of )?(?:the )?server side public L ; licensed under the server side public license
python-2.0    ; 0.85 ; (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:psf|python(?: software foundation)?) L ; distributed under the python software foundation license
openssl       ; 0.9 ; this product includes software developed by the openssl project ; this product includes software developed by the openssl project
"""

NAMES = """
apache-1.0    ; 0.75 ; apache(?: software)? L V1 0                               ; apache license version 1 0
apache-1.1    ; 0.75 ; apache(?: software)? L V1 1                               ; apache software license 1 1
apache-2.0    ; 0.75 ; apache(?: software)? L V2(?: 0)?                          ; apache license version 2 0
apache-2.0    ; 0.75 ; asl 2 0                                                   ; asl 2 0
apache        ; 0.6 ; apache(?: software)? L                                     ; apache license
mit           ; 0.75 ; (?:the )?mit(?: expat| x11)? L                            ; the mit license
mit           ; 0.7 ; expat L                                                    ; expat license
x11           ; 0.75 ; x11 L                                                     ; x11 license
isc           ; 0.75 ; isc L                                                     ; isc license
0bsd          ; 0.75 ; 0bsd                                                      ; 0bsd
0bsd          ; 0.75 ; zero clause bsd                                           ; zero clause bsd
bsd-2-clause  ; 0.75 ; bsd 2 clause                                              ; bsd 2 clause
bsd-2-clause  ; 0.75 ; 2 clause bsd                                              ; 2 clause bsd
bsd-2-clause  ; 0.75 ; simplified bsd                                            ; simplified bsd
bsd-2-clause  ; 0.75 ; freebsd L                                                 ; freebsd license
bsd-3-clause  ; 0.75 ; bsd 3 clause                                              ; bsd 3 clause
bsd-3-clause  ; 0.75 ; 3 clause bsd                                              ; 3 clause bsd
bsd-3-clause  ; 0.75 ; (?:new|modified|revised) bsd                              ; modified bsd
bsd-4-clause  ; 0.75 ; bsd 4 clause                                              ; bsd 4 clause
bsd-4-clause  ; 0.75 ; 4 clause bsd                                              ; 4 clause bsd
bsd-4-clause  ; 0.75 ; original bsd                                              ; original bsd
bsd           ; 0.7 ; bsd(?: style| like)? L                                     ; bsd style license
gpl-1.0       ; 0.75 ; (?:gnu )?general public L(?: gpl)? V1(?: 0)?              ; gnu general public license version 1
gpl-2.0       ; 0.75 ; (?:gnu )?general public L(?: gpl)? V2(?: 0)?(?: only| or later)? ; general public license v 2
gpl-3.0       ; 0.75 ; (?:gnu )?general public L(?: gpl)? V3(?: 0)?(?: only| or later)? ; gnu general public license gpl version 3
gpl-2.0       ; 0.75 ; (?:gnu )?gpl (?:version )?v?2(?: 0)?(?: only| or later)?  ; gnu gpl v2
gpl-2.0       ; 0.75 ; (?:gnu )?gplv2                                            ; gplv2
gpl-2.0       ; 0.75 ; (?:gnu )?gpl2                                             ; gpl2
gpl-3.0       ; 0.75 ; (?:gnu )?gpl (?:version )?v?3(?: 0)?(?: only| or later)?  ; gpl 3 0
gpl-3.0       ; 0.75 ; (?:gnu )?gplv3                                            ; gnu gplv3
gpl-3.0       ; 0.75 ; (?:gnu )?gpl3                                             ; gpl3
gpl           ; 0.7 ; gnu gpl                                                    ; gnu gpl
gpl           ; 0.7 ; (?:gnu )?general public L                                  ; gnu general public license
gpl           ; 0.5 ; gpl                                                        ; gpl
lgpl-2.0      ; 0.75 ; (?:gnu )?library general public L(?: V2(?: 0)?)?          ; gnu library general public license version 2
lgpl-2.1      ; 0.75 ; (?:gnu )?lesser general public L V2 1                     ; lesser general public license version 2 1
lgpl-3.0      ; 0.75 ; (?:gnu )?lesser general public L V3(?: 0)?                ; gnu lesser general public license v 3
lgpl-2.1      ; 0.75 ; (?:gnu )?lgpl V2 1                                        ; lgpl 2 1
lgpl-2.1      ; 0.75 ; lgplv2(?: 1)?                                             ; lgplv2 1
lgpl-3.0      ; 0.75 ; (?:gnu )?lgpl V3(?: 0)?                                   ; lgpl v 3
lgpl-3.0      ; 0.75 ; lgplv3                                                    ; lgplv3
lgpl          ; 0.7 ; (?:gnu )?lesser general public L                           ; lesser general public license
lgpl          ; 0.7 ; (?:gnu )?lgpl                                              ; gnu lgpl
agpl-3.0      ; 0.75 ; (?:gnu )?affero general public L(?: V3(?: 0)?)?           ; gnu affero general public license version 3
agpl-3.0      ; 0.75 ; (?:gnu )?agplv3                                           ; agplv3
agpl-3.0      ; 0.75 ; (?:gnu )?agpl3                                            ; agpl3
agpl-3.0      ; 0.75 ; (?:gnu )?agpl(?: v?3(?: 0)?)?                             ; agpl 3 0
gfdl          ; 0.75 ; (?:gnu )?free documentation L(?: V1 [123])?               ; gnu free documentation license version 1 3
gfdl          ; 0.7 ; gfdl                                                       ; gfdl
mpl-1.1       ; 0.75 ; mozilla public L V1 1                                     ; mozilla public license version 1 1
mpl-2.0       ; 0.75 ; mozilla public L V2(?: 0)?                                ; mozilla public license 2 0
mpl           ; 0.7 ; mozilla public L                                           ; mozilla public license
mpl-2.0       ; 0.7 ; mpl V2 0                                                   ; mpl 2 0
epl-1.0       ; 0.75 ; eclipse public L V1(?: 0)?                                ; eclipse public license version 1 0
epl-2.0       ; 0.75 ; eclipse public L V2(?: 0)?                                ; eclipse public license 2 0
epl           ; 0.7 ; eclipse public L                                           ; eclipse public license
cddl-1.0      ; 0.75 ; common development and distribution L(?: V1 [01])?        ; common development and distribution license 1 0
cddl-1.0      ; 0.7 ; cddl                                                       ; cddl
cpl-1.0       ; 0.75 ; common public L(?: V1 0)?                                 ; common public license 1 0
ipl-1.0       ; 0.75 ; ibm public L(?: V1 0)?                                    ; ibm public license version 1 0
artistic-1.0  ; 0.75 ; artistic L(?: V1 0)?                                      ; artistic license 1 0
artistic-2.0  ; 0.75 ; artistic L V2 0                                           ; artistic license 2 0
perl          ; 0.7 ; perl L                                                     ; perl license
zlib          ; 0.75 ; zlib(?: libpng)? L                                        ; zlib libpng license
libpng        ; 0.75 ; libpng L                                                  ; libpng license
boost-1.0     ; 0.75 ; boost software L(?: V1 0)?                                ; boost software license version 1 0
unlicense     ; 0.75 ; (?:the )?unlicense                                        ; the unlicense
wtfpl         ; 0.75 ; wtfpl                                                     ; wtfpl
beerware      ; 0.75 ; beer ?ware L                                              ; beer ware license
python-2.0    ; 0.75 ; python software foundation L(?: V2)?                      ; python software foundation license version 2
php-3.01      ; 0.75 ; php L(?: V3 01)?                                          ; php license version 3 01
ruby          ; 0.75 ; ruby L                                                    ; ruby license
openssl       ; 0.75 ; openssl L                                                 ; openssl license
postgresql    ; 0.75 ; postgresql L                                              ; postgresql license
curl          ; 0.7 ; curl L                                                     ; curl license
ncsa          ; 0.75 ; (?:university of illinois )?ncsa open source L            ; university of illinois ncsa open source license
w3c           ; 0.75 ; w3c software(?: notice and)? L                            ; w3c software notice and license
afl-3.0       ; 0.75 ; academic free L(?: V3 0)?                                 ; academic free license version 3 0
osl-3.0       ; 0.75 ; open software L(?: V3 0)?                                 ; open software license 3 0
upl-1.0       ; 0.75 ; universal permissive L(?: V1 0)?                          ; universal permissive license v 1 0
ofl-1.1       ; 0.75 ; (?:sil )?open font L(?: V1 1)?                            ; sil open font license version 1 1
eupl-1.2      ; 0.75 ; european union public L(?: V1 [12])?                      ; european union public license v 1 2
cecill        ; 0.75 ; cecill(?: [abc])?(?: L)?                                  ; cecill b license
ms-pl         ; 0.75 ; microsoft public L                                        ; microsoft public license
ms-rl         ; 0.75 ; microsoft reciprocal L                                    ; microsoft reciprocal license
apsl-2.0      ; 0.75 ; apple public source L(?: V2 0)?                           ; apple public source license 2 0
qpl-1.0       ; 0.75 ; q public L(?: V1 0)?                                      ; q public license 1 0
sspl-1.0      ; 0.75 ; server side public L                                      ; server side public license
busl-1.1      ; 0.75 ; business source L(?: V1 1)?                               ; business source license 1 1
elastic-2.0   ; 0.75 ; elastic L(?: V2(?: 0)?)?                                  ; elastic license 2 0
commons-clause ; 0.75 ; commons clause                                           ; commons clause
polyform      ; 0.75 ; polyform (?:noncommercial|small business|strict|shield|perimeter) L ; polyform noncommercial license
rail          ; 0.75 ; (?:open|big ?science) rail(?: m)?(?: L)?                  ; bigscience rail license
llama         ; 0.7 ; llama [234](?: [123])? community L                         ; llama 3 community license
odbl-1.0      ; 0.75 ; open (?:data commons open )?database L(?: V1 0)?          ; open data commons open database license
odbl-1.0      ; 0.7 ; odbl                                                       ; odbl
odc-by-1.0    ; 0.75 ; open data commons attribution L                           ; open data commons attribution license
pddl-1.0      ; 0.75 ; public domain dedication and L                            ; public domain dedication and license
cdla          ; 0.75 ; community data L agreement                                ; community data license agreement
ogl-3.0       ; 0.75 ; open government L(?: V[123] 0)?                           ; open government license v3 0
cc0-1.0       ; 0.75 ; cc0(?: 1 0)?                                              ; cc0 1 0
cc0-1.0       ; 0.75 ; creative commons zero(?: 1 0)?                            ; creative commons zero
cc-pdm        ; 0.75 ; public domain mark(?: 1 0)?                               ; public domain mark 1 0
cc-by-nc-sa   ; 0.75 ; cc by nc sa(?: [1234] [05])?                              ; cc by nc sa 4 0
cc-by-nc-nd   ; 0.75 ; cc by nc nd(?: [1234] [05])?                              ; cc by nc nd 4 0
cc-by-sa      ; 0.75 ; cc by sa(?: [1234] [05])?                                 ; cc by sa 3 0
cc-by-nc      ; 0.75 ; cc by nc(?: [1234] [05])?                                 ; cc by nc
cc-by-nd      ; 0.75 ; cc by nd(?: [1234] [05])?                                 ; cc by nd
cc-by-4.0     ; 0.75 ; cc by 4 0                                                 ; cc by 4 0
cc-by-3.0     ; 0.75 ; cc by 3 0                                                 ; cc by 3 0
cc-by-nc-sa   ; 0.75 ; creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)? ; creative commons attribution non commercial share alike 4 0 international
cc-by-nc-nd   ; 0.75 ; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)? ; creative commons attribution noncommercial noderivatives 4 0
cc-by-sa      ; 0.75 ; creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)? ; creative commons attribution sharealike 3 0 unported
cc-by-nc      ; 0.75 ; creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)? ; creative commons attribution noncommercial
cc-by-nd      ; 0.75 ; creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)? ; creative commons attribution noderivs 3 0 unported
cc-by         ; 0.7 ; creative commons attribution(?: [1234] [05])?(?: international| unported)? ; creative commons attribution 4 0 international
cc            ; 0.65 ; creative commons L                                        ; creative commons license
cc            ; 0.6 ; creativecommons org licenses [^ ]+                         ; creativecommons org licenses by
"""

NOTICES = """
reserved      ; 0.9 ; all rights (?:are )?reserved                               ; all rights are reserved
reserved      ; 0.8 ; alle rechte vorbehalten                                    ; alle rechte vorbehalten
reserved      ; 0.8 ; tous droits (?:de reproduction )?réservés                  ; tous droits réservés
reserved      ; 0.8 ; todos los derechos reservados                              ; todos los derechos reservados
reserved      ; 0.8 ; todos os direitos reservados                               ; todos os direitos reservados
reserved      ; 0.8 ; tutti i diritti riservati                                  ; tutti i diritti riservati
reserved      ; 0.8 ; alle rechten voorbehouden                                  ; alle rechten voorbehouden
reserved      ; 0.6 ; some rights reserved                                       ; some rights reserved
reserved      ; 0.6 ; no rights reserved                                         ; no rights reserved
copyright     ; 0.6 ; copyright (?:c )?(?:by )?(?:19|20)\\d\\d                   ; copyright c 2020
copyright     ; 0.6 ; copyright (?:c )?[^ ]+ (?:19|20)\\d\\d                     ; copyright somebody 2019
copyright     ; 0.5 ; copyrighted (?:material|work|content)                      ; copyrighted material
copyright     ; 0.4 ; copyright                                                  ; copyright
copyright     ; 0.4 ; urheberrecht                                               ; urheberrecht
copyright     ; 0.4 ; droits? d auteur                                           ; droit d auteur
copyright     ; 0.4 ; derechos de autor                                          ; derechos de autor
public-domain ; 0.8 ; (?:released|dedicated|placed|work is|is) (?:in|into|to) the public domain ; released into the public domain
public-domain ; 0.5 ; public domain                                              ; public domain
proprietary   ; 0.9 ; proprietary and confidential                               ; proprietary and confidential
proprietary   ; 0.9 ; confidential and proprietary                               ; confidential and proprietary
proprietary   ; 0.8 ; unauthori[sz]ed (?:copying|use|reproduction|distribution)  ; unauthorized copying
proprietary   ; 0.8 ; may not be (?:reproduced|copied|redistributed|distributed)(?: or (?:transmitted|distributed|used))? (?:without|in any form) ; may not be reproduced or transmitted without
proprietary   ; 0.8 ; no part of this (?:publication|work|book|document|site) may be ; no part of this publication may be
proprietary   ; 0.7 ; trade secrets? of                                          ; trade secret of
proprietary   ; 0.7 ; end user L agreement                                       ; end user license agreement
proprietary   ; 0.6 ; eula                                                       ; eula
proprietary   ; 0.6 ; internal use only                                          ; internal use only
noncommercial ; 0.7 ; (?:for )?non ?commercial use only                          ; for noncommercial use only
noncommercial ; 0.7 ; (?:for )?(?:personal|educational|academic|research) (?:and [^ ]+ )?use only ; for personal use only
noncommercial ; 0.6 ; not for (?:commercial use|resale)                          ; not for resale
reprint       ; 0.7 ; (?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission ; reprinted with permission
reprint       ; 0.6 ; with(?:out)? (?:the )?(?:prior )?written permission        ; without the prior written permission
warranty      ; 0.5 ; (?:provided )?as is without warranty                       ; provided as is without warranty
warranty      ; 0.5 ; without (?:even )?(?:the )?implied warranty of merchantability ; without even the implied warranty of merchantability
warranty      ; 0.5 ; without warranties or conditions of any kind               ; without warranties or conditions of any kind
warranty      ; 0.5 ; in no event shall the (?:authors?|copyright holders?)      ; in no event shall the authors
attribution   ; 0.5 ; attribution (?:is )?required                               ; attribution required
trademark     ; 0.4 ; (?:registered )?trademarks? of                             ; registered trademark of
licensed      ; 0.4 ; licensed under                                             ; licensed under
licensed      ; 0.4 ; terms of (?:use|service)                                   ; terms of use
licensed      ; 0.4 ; L agreement                                                ; license agreement
"""


@dataclass(frozen=True)
class Rule:
    label: str
    weight: float
    text: str
    pattern: re.Pattern
    gate: frozenset  # a text that the pattern matches has one of these words
    priority: int
    example: str


#: Words that say little; a gate has one only where a match may have no other.
COMMON = frozenset("the of to in is a and or by for it this as be under use with v version any all not you may must no only are c cc open free work".split())


def variants(items) -> list[str]:
    """The texts that a parsed pattern matches; what isn't fixed, or has many values, is a null character."""
    out = [""]
    for op, value in items:
        if op is kind.LITERAL:
            found = [chr(value)]
        elif op is kind.SUBPATTERN:
            found = variants(value[3])
        elif op is kind.BRANCH:
            found = [v for branch in value[1] for v in variants(branch)]
        elif op is kind.MAX_REPEAT and value[:2] == (0, 1):
            found = ["", *variants(value[2])]
        elif op is kind.IN and all(x is kind.LITERAL for x, _ in value):
            found = [chr(c) for _, c in value]
        else:
            found = ["\0"]
        out = [x + y for x in out for y in found]
    return out


def gate(pattern: str) -> frozenset:
    """Words one of which stands in every match of a pattern whose matches begin and end with whole words."""
    left = [{w for w in v.split(" ") if w and "\0" not in w} for v in variants(parser.parse(pattern))]
    out = set()
    while left:
        words = {w for x in left for w in (x - COMMON or x)}
        if not all(left):
            raise ValueError(f"some match of {pattern} has no fixed word")
        best = max(words, key=lambda w: (sum(w in x for x in left), not w.isdigit(), len(w), w))
        out.add(best)
        left = [x for x in left if best not in x]
    return frozenset(out)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, by priority."""
    out = []
    for priority, table in enumerate((TAGS, TEXTS, NAMES, NOTICES)):
        for line in table.strip().splitlines():
            label, weight, text, example = (x.strip() for x in line.split(" ;") if x.strip())
            text = re.sub(r"\bL\b", "licen[sc]e", re.sub(r"\bV(?=[\d\[])", "(?:version |v )?v?", text)).replace("\\\\", "\\")
            out.append(Rule(label, float(weight), text, re.compile(rf"(?:^|(?<= ))(?:{text})(?![^ ])"), gate(text), priority, example))
    return tuple(out)
