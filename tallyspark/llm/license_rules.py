"""Signature rules of the licence scan, written one by one for lower-cased text with single blanks for white space.

A line has label, keyword and regular expression: the keyword stands in whatever the expression matches. Groups share a
priority and a confidence; a later group never outranks an earlier one.
"""

from __future__ import annotations

#: What a licence file or a source header says in so many words: priority 4.
BODIES = r"""
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
mit | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software .{0,120}without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided
x11 | x consortium | except as contained in this notice, the name of the x consortium shall not be used in advertising
isc | permission to use | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
isc | permission to use | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
0bsd | permission to use | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
hpnd | permission to use | permission to use, copy, modify,? and distribute this software and its documentation for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | endorse or promote | neither the names? of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice.{0,160}and/or other materials provided with the distribution\. this software is provided
zlib | as-is | this software is provided 'as-is', without any express or implied warranty
zlib | misrepresented | the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib | plainly marked | altered source versions must be plainly marked as such,? and must not be misrepresented
boost | permission is hereby granted | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | free to copy | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
wtfpl | do what the fuck | you just do what the fuck you want to
wtfpl | do what the fuck | do what the fuck you want to public licen[sc]e
beer-ware | beer-ware | "?the beer-ware licen[sc]e"?
gpl | is free software | this (?:program|library|file|package) is free software;? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
gpl-2.0-or-later | either version 2 | gnu general public licen[sc]e as published by the free software foundation[;,] either version 2 of the licen[sc]e,? or
gpl-3.0-or-later | either version 3 | gnu general public licen[sc]e as published by the free software foundation[;,] either version 3 of the licen[sc]e,? or
gpl-2.0-only | version 2 of the licen | gnu general public licen[sc]e as published by the free software foundation[;,] version 2 of the licen[sc]e
gpl-3.0-only | version 3 of the licen | gnu general public licen[sc]e as published by the free software foundation[;,] version 3 of the licen[sc]e
gpl | received a copy | you should have received a copy of the gnu general public licen[sc]e
gpl | without any warranty | in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[sc]e
gpl | general public license | the gnu general public license is a free, copyleft license for software and other kinds of works
gpl-2.0 | licenses for most software | the licenses for most software are designed to take away your freedom to share and change it
lgpl | lesser general public | free software;? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1-or-later | either version 2.1 | gnu lesser general public licen[sc]e as published by the free software foundation[;,] either version 2\.1 of the licen[sc]e,? or
lgpl-3.0-or-later | lesser general public | gnu lesser general public licen[sc]e as published by the free software foundation[;,] either version 3 of the licen[sc]e,? or
lgpl-2.0-or-later | library general public | gnu library general public licen[sc]e as published by the free software foundation[;,] either version 2 of the licen[sc]e,? or
lgpl | received a copy | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
agpl-3.0 | affero general public | free software:? you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e
agpl-3.0-or-later | affero general public | gnu affero general public licen[sc]e as published by the free software foundation[;,] either version 3 of the licen[sc]e,? or
agpl-3.0 | received a copy | you should have received a copy of the gnu affero general public licen[sc]e
agpl-3.0 | remote network interaction | remote network interaction; use with the gnu general public licen[sc]e
gfdl | free documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl | invariant sections | with no invariant sections, no front-cover texts,? and no back-cover texts(?=.{0,200}licen[cs])
apache-2.0 | apache license | licensed under the apache license, version 2\.0 \(the "?license"?\)
apache-2.0 | except in compliance | you may not use this file except in compliance with the license
apache-2.0 | as is | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
apache-2.0 | contributor license | licensed to the apache software foundation \(asf\) under one or more contributor license agreements
apache-2.0 | terms and conditions for use | terms and conditions for use, reproduction, and distribution(?=.{0,400}licens)
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation .{0,60}licen[sc]e
mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public licen[sc]e, v\. ?2\.0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public licen[sc]e version 1\.1
mpl-2.0 | incompatible with secondary | this source code form is "incompatible with secondary licen[sc]es"
epl-1.0 | eclipse public | the accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?1\.0
epl-2.0 | eclipse public | the accompanying materials are made available under the terms of the eclipse public licen[sc]e v?\.? ?2\.0
epl | eclipse public | the accompanying program is provided under the terms of this eclipse public licen[sc]e
cddl-1.0 | common development | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cpl-1.0 | common public | the accompanying program is provided under the terms of this common public licen[sc]e
ms-pl | microsoft public | this licen[sc]e governs use of the accompanying software\. if you use the software, you accept this licen[sc]e.{0,400}microsoft public
ncsa | deal with the software | deal with the software without restriction, including without limitation the rights to use, copy, modify, merge(?=.{0,900}licen[cs])
eupl | european union public | licensed under the eupl,? (?:version|v\.?) ?1\.[12].{0,200}european union public licen[sc]e
artistic-2.0 | artistic license | everyone is permitted to copy and distribute verbatim copies of this license document.{0,400}artistic license
psf-2.0 | python software foundation | this license agreement is between the python software foundation
openssl | openssl project | this product includes software developed by the openssl project.{0,120}licen[sc]e
php | php license | this product includes php(?: software)?, freely available from.{0,120}php license
vim | vim license | you can freely distribute unmodified copies of vim.{0,200}vim license
json | good, not evil | the software shall be used for good, not evil
ofl-1.1 | open font | this font software is licensed under the sil open font licen[sc]e, version 1\.1
ofl-1.1 | reserved font name | with reserved font name .{1,80}(?=.{0,300}licen[cs])
cc0-1.0 | possible under law | to the extent possible under law, .{1,120}? has waived all copyright and related or neighboring rights
cc0-1.0 | cc0 | the person who associated a work with this deed has dedicated the work to the public domain.{0,300}cc0
cc-by-4.0 | creative commons | this work is licensed under a creative commons attribution 4\.0 international licen[sc]e
cc-by-sa-4.0 | creative commons | this work is licensed under a creative commons attribution-sharealike 4\.0 international licen[sc]e
cc-by-sa-3.0 | creative commons | text is available under the creative commons attribution-share ?alike(?: licen[sc]e)?(?: 3\.0)?
cc-by-nc-4.0 | creative commons | this work is licensed under a creative commons attribution-noncommercial 4\.0 international licen[sc]e
cc-by-nd-4.0 | creative commons | this work is licensed under a creative commons attribution-noderivatives 4\.0 international licen[sc]e
cc-by-nc-sa-4.0 | creative commons | this work is licensed under a creative commons attribution-noncommercial-sharealike 4\.0 international licen[sc]e
cc-by-nc-nd-4.0 | creative commons | this work is licensed under a creative commons attribution-noncommercial-noderivatives 4\.0 international licen[sc]e
odbl-1.0 | open database | is made available under the open database licen[sc]e
odc-by | open data commons | is made available under the open data commons attribution licen[sc]e
pddl | public domain dedication | is made available under the public domain dedication and licen[sc]e
ogl-uk-3.0 | open government | contains public sector information licensed under the open government licen[sc]e v3\.0
proprietary | permission of | no part of this (?:publication|book|work|document) may be reproduced.{0,200}? without (?:the )?(?:prior )?(?:written )?permission of
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)[.,;:]? .{0,80}all rights reserved
proprietary | unauthorized copying | unauthorized copying of this file, via any medium,? is strictly prohibited(?=.{0,200}(?:all rights reserved|licen[cs]))
"""

#: A notice that puts a work under a named licence: priority 3.
NOTICES = r"""
mit | mit | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat) licen[sc]e
mit | mit | (?:code|software|project|package|library) is mit[- ]licen[sc]ed
mit | mit | licen[sc]e ?[:=] ?["']?mit\b
x11 | x11 | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?x11 licen[sc]e
isc | isc | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e
isc | isc | licen[sc]e ?[:=] ?["']?isc\b
bsd-2-clause | bsd | (?:licen[sc]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?(?:2|two)-clause bsd(?:-style)? licen[sc]e
bsd-2-clause | bsd | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:simplified|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | (?:licen[sc]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?(?:3|three)-clause bsd(?:-style)? licen[sc]e
bsd-3-clause | bsd | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:new|revised|modified) bsd licen[sc]e
bsd | bsd | (?:use of this source code is )?governed by a bsd-style licen[sc]e
bsd | bsd | (?:licen[sc]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?:-style)? licen[sc]e
bsd | bsd | licen[sc]e ?[:=] ?["']?bsd\b(?!-)
bsd-3-clause | bsd-3-clause | licen[sc]e ?[:=] ?["']?bsd-3-clause
bsd-2-clause | bsd-2-clause | licen[sc]e ?[:=] ?["']?bsd-2-clause
apache-2.0 | apache | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b
apache-2.0 | apache | licen[sc]e ?[:=] ?["']?apache[- ](?:licen[sc]e )?2(?:\.0)?
apache-2.0 | asl 2.0 | (?:licen[sc]e ?[:=] ?|licen[sc]ed under (?:the )?)asl 2\.0
apache-1.1 | apache | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?apache software licen[sc]e,? (?:version |v\.? ?)?1\.1
apache | apache | (?:licen[sc]ed|released|distributed|available) under (?:the |an )?(?:terms of (?:the )?)?apache licen[sc]e
gpl-2.0 | general public | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b
gpl-3.0 | general public | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b
gpl | general public | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e
gpl-2.0 | gpl | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl[- ]?v?2(?:\.0)?\b
gpl-3.0 | gpl | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl[- ]?v?3(?:\.0)?\b
gpl | gpl | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl\b(?![- ]?v?\d)
gpl-2.0 | gpl | licen[sc]e ?[:=] ?["']?gpl[- ]?v?2(?:\.0)?\b
gpl-3.0 | gpl | licen[sc]e ?[:=] ?["']?gpl[- ]?v?3(?:\.0)?\b
lgpl | lesser general | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public licen[sc]e
lgpl-2.1 | lgpl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl[- ]?v?2\.1
lgpl-3.0 | lgpl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl[- ]?v?3(?:\.0)?\b
lgpl | lgpl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl\b(?![- ]?v?\d)
agpl-3.0 | affero | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[sc]e
agpl-3.0 | agpl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl
gfdl | free documentation | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?free documentation licen[sc]e
gfdl | gfdl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gfdl
mpl-2.0 | mozilla | (?:licen[sc]ed|released|distributed|subject to|available) (?:under )?(?:the )?(?:terms of (?:the )?)?mozilla public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b
mpl-1.1 | mozilla | (?:licen[sc]ed|released|distributed|subject to|available) (?:under )?(?:the )?(?:terms of (?:the )?)?mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1
mpl | mpl | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?mpl\b
epl-2.0 | eclipse | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)?2(?:\.0)?
epl-1.0 | eclipse | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)?1(?:\.0)?
cddl-1.0 | cddl | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?cddl
eupl | european union | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?european union public licen[sc]e
zlib | zlib | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?zlib(?:/libpng)? licen[sc]e
boost | boost | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?boost software licen[sc]e
artistic | artistic | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:perl )?artistic licen[sc]e
perl | perl itself | under the same terms as perl itself(?=.{0,300}licen[cs])|same (?:licen[sc]e|licen[sc]ing terms) as perl itself
psf-2.0 | python | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?python software foundation licen[sc]e
postgresql | postgresql | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?postgresql licen[sc]e
ruby | ruby | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?ruby licen[sc]e
ms-pl | microsoft public | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?microsoft public licen[sc]e
unlicense | unlicense | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?unlicense
wtfpl | wtfpl | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?wtfpl
public-domain | public domain | (?:released|dedicated|placed|put|hereby) (?:in|into|to) the public domain
public-domain | public domain | (?:this (?:work|text|file|image|software|book)|it) is (?:in|part of) the public domain
cc0-1.0 | cc0 | (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?(?:creative commons )?cc0
cc-by-sa | cc | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?cc[- ]by-sa
cc-by-nc-sa | cc | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?cc[- ]by-nc-sa
cc-by-nc-nd | cc | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?cc[- ]by-nc-nd
cc-by-nc | cc | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?cc[- ]by-nc(?!-(?:sa|nd))
cc-by-nd | cc | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?cc[- ]by-nd
cc-by | cc | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?cc[- ]by\b(?!-)
cc-by | creative commons | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?creative commons attribution(?![ -]?(?:share|non|no))
cc-by-sa | creative commons | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?creative commons attribution[ -]share[ -]?alike
cc-by-nc | creative commons | (?:licen[sc]ed|released|distributed|published|shared|available) under (?:the |a )?(?:terms of (?:the )?)?creative commons attribution[ -]non[ -]?commercial(?![ -](?:share|no))
creative-commons | creative commons | under a creative commons licen[sc]e
ofl-1.1 | open font | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:sil )?open font licen[sc]e
odbl-1.0 | odbl | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?odbl
bsl-1.1 | business source | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?business source licen[sc]e
sspl-1.0 | server side public | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?server side public licen[sc]e
elastic-2.0 | elastic license | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?elastic license
proprietary | user licen | (?:this|the) end[- ]user licen[sc]e agreement
proprietary | commercial | (?:available|sold|distributed) under (?:a|the) commercial licen[sc]e
proprietary | proprietary | (?:licen[sc]ed|released|distributed) under a proprietary licen[sc]e
"""

#: Addresses of licence texts: priority 2.
ADDRESSES = r"""
apache-2.0 | apache.org/licenses | apache\.org/licenses/license-2\.0
apache-1.1 | apache.org/licenses | apache\.org/licenses/license-1\.1
mit | opensource.org/licenses | opensource\.org/licenses/mit
isc | opensource.org/licenses | opensource\.org/licenses/isc
bsd-2-clause | opensource.org/licenses | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | opensource.org/licenses | opensource\.org/licenses/bsd-3-clause
bsd | opensource.org/licenses | opensource\.org/licenses/bsd-license
zlib | opensource.org/licenses | opensource\.org/licenses/zlib
artistic-2.0 | opensource.org/licenses | opensource\.org/licenses/artistic-license-2\.0
ms-pl | opensource.org/licenses | opensource\.org/licenses/ms-pl
cpl-1.0 | opensource.org/licenses | opensource\.org/licenses/cpl1\.0
cddl-1.0 | opensource.org/licenses | opensource\.org/licenses/cddl-?1
gpl | gnu.org/licenses | gnu\.org/licenses/(?:gpl(?:\.html|\.txt)?\b(?!-)|old-licenses/?(?= |$))
gpl-2.0 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | gnu.org/licenses | gnu\.org/licenses/gpl-3\.0
lgpl-2.1 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | gnu.org/licenses | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | gnu.org/licenses | gnu\.org/licenses/agpl
gfdl | gnu.org/licenses | gnu\.org/licenses/fdl
gpl | gnu.org/copyleft | gnu\.org/copyleft/gpl
mpl-2.0 | mozilla.org/mpl | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mozilla.org/mpl | mozilla\.org/mpl/mpl-1\.1
epl-1.0 | epl-v10 | eclipse\.org/legal/epl-v10(?=.{0,200}(?:licen[cs]))
epl-2.0 | epl-2.0 | eclipse\.org/legal/epl-2\.0(?=.{0,200}(?:licen[cs]))
cc-by-4.0 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
cc-by-2.0 | creativecommons.org | creativecommons\.org/licenses/by/2\.[05]
cc-by-sa-4.0 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nd-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3\.0
cc0-1.0 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
public-domain | creativecommons.org | creativecommons\.org/publicdomain/mark
unlicense | unlicense.org | \bunlicense\.org
boost | license_1_0.txt | boost\.org/license_1_0\.txt
ofl-1.1 | ofl | scripts\.sil\.org/ofl(?=.{0,200}licen[cs])
odbl-1.0 | opendatacommons.org | opendatacommons\.org/licenses/odbl
ogl-uk-3.0 | open-government-licence | nationalarchives\.gov\.uk/doc/open-government-licence/version/3
eupl | eupl | joinup\.ec\.europa\.eu/.{0,60}eupl(?=.{0,200}licen[cs])
"""

#: Bare names: priority 1.
TITLES = r"""
gpl-2.0 | general public | (?:gnu )?general public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b(?!\.\d)
gpl-3.0 | general public | (?:gnu )?general public licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b(?!\.\d)
gpl | general public | gnu general public licen[sc]e
gpl | gpl | \bgpl\b
gpl-2.0 | gpl | \bgpl(?:-| )?v?2(?:\.0)?(?:-only|-or-later|\+)?(?![.\d])
gpl-3.0 | gpl | \bgpl(?:-| )?v?3(?:\.0)?(?:-only|-or-later|\+)?(?![.\d])
lgpl | lesser general | (?:gnu )?lesser general public licen[sc]e
lgpl | library general | gnu library general public licen[sc]e
lgpl | lgpl | \blgpl\b
lgpl-2.1 | lgpl | \blgpl(?:-| )?v?2\.1(?:-only|-or-later|\+)?
lgpl-3.0 | lgpl | \blgpl(?:-| )?v?3(?:\.0)?(?:-only|-or-later|\+)?(?![.\d])
agpl-3.0 | affero | (?:gnu )?affero general public licen[sc]e
agpl-3.0 | agpl | \bagpl(?:(?:-| )?v?3(?:\.0)?)?\b
gfdl | free documentation | (?:gnu )?free documentation licen[sc]e
apache-2.0 | apache | apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?(?!\d)
apache-1.1 | apache | apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?1\.1
apache | apache | apache(?: software)? licen[sc]e
mit | mit | \b(?:mit|expat) licen[sc]e
x11 | x11 | \bx11 licen[sc]e
bsd-2-clause | bsd | (?:simplified|2-clause|two-clause|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | (?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e
bsd-4-clause | bsd | (?:original|4-clause|four-clause) bsd licen[sc]e
bsd | bsd | \bbsd(?:-style)? licen[sc]e
mpl-1.1 | mozilla | mozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.1
mpl-2.0 | mozilla | mozilla public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?
mpl | mozilla | mozilla public licen[sc]e
epl | eclipse | eclipse public licen[sc]e
cddl-1.0 | common development | common development and distribution licen[sc]e
cpl-1.0 | common public | common public licen[sc]e
eupl | european union | european union public licen[sc]e
isc | isc | \bisc licen[sc]e
zlib | zlib | \bzlib(?:/libpng)? licen[sc]e
artistic | artistic | \bartistic licen[sc]e
artistic-2.0 | artistic | \bartistic licen[sc]e,? ?(?:version)? ?2\.0
boost | boost | boost software licen[sc]e
unlicense | unlicense | \bunlicense\b
wtfpl | wtfpl | \bwtfpl\b
ofl-1.1 | open font | (?:sil )?open font licen[sc]e
psf-2.0 | python software | python software foundation licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
ncsa | ncsa | (?:university of illinois/)?ncsa open source licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
osl-3.0 | open software | open software licen[sc]e
afl-3.0 | academic free | academic free licen[sc]e
upl-1.0 | universal permissive | universal permissive licen[sc]e
bsl-1.1 | business source | business source licen[sc]e
sspl-1.0 | server side public | server side public licen[sc]e
odbl-1.0 | open database | open database licen[sc]e
ogl-uk-3.0 | open government | open government licen[sc]e
cc0-1.0 | cc0 | \bcc0(?:[ -]1\.0)?\b
public-domain | public domain | \bpublic domain\b
cc-by | cc | \bcc[ -]by(?:[ -]\d\.\d)?(?![ -](?:nc|nd|sa))\b
cc-by-sa | cc | \bcc[ -]by-sa(?:[ -]\d\.\d)?\b
cc-by-nc | cc | \bcc[ -]by-nc(?:[ -]\d\.\d)?(?!-)\b
cc-by-nc-sa | cc | \bcc[ -]by-nc-sa(?:[ -]\d\.\d)?\b
cc-by-nd | cc | \bcc[ -]by-nd(?:[ -]\d\.\d)?\b
cc-by-nc-nd | cc | \bcc[ -]by-nc-nd(?:[ -]\d\.\d)?\b
cc-by-sa | creative commons | creative commons attribution[ -]share[ -]?alike
cc-by-nc | creative commons | creative commons attribution[ -]non[ -]?commercial(?![ -](?:share|no))
cc-by-nd | creative commons | creative commons attribution[ -]no[ -]?deriv(?:ative)?s
cc-by | creative commons | creative commons attribution(?![ -](?:share|non|no))
creative-commons | creative commons | creative commons licen[sc]e
proprietary | all rights reserved | all rights reserved
"""

#: Identifiers of SPDX tags: each gives one rule, for the tag naming it alone or in an expression: priority 5.
SPDX = (
    "0bsd", "afl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-1.1", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsl-1.0", "cc-by-4.0",
    "cc-by-sa-4.0", "cc-by-nc-4.0", "cc0-1.0", "cddl-1.0", "cpl-1.0", "epl-1.0", "epl-2.0", "eupl-1.2", "gfdl-1.3-only", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only",
    "gpl-3.0-or-later", "isc", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ms-pl", "ncsa", "odbl-1.0", "ofl-1.1",
    "openssl", "osl-3.0", "postgresql", "psf-2.0", "unlicense", "upl-1.0", "wtfpl", "zlib",
)

#: Every match of a rule has one of these: the gate that a text must pass before its keywords are looked for.
GATE = (
    r"(?i)(?=[acefglmoprw])(?:licen[cs]|gpl|creative ?commons|public domain|all rights reserved|wtfpl|cc0|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"
    r"|permission\s+(?:is|to|of|notice)|redistribution|copyleft|what\s+the\s+fuck|misrepresented|as-is|advertising|acknowledge|good,\s+not\s+evil|endorse\s+or|all\s+copyright|free\s+to\s+copy|gfdl|\bmpl\b|odbl|cddl|without\s+any\s+warranty)"
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regular expression, priority, confidence)."""
    out = []
    for table, priority, confidence in ((BODIES, 4, 0.99), (NOTICES, 3, 0.95), (ADDRESSES, 2, 0.9), (TITLES, 1, 0.8)):
        for line in table.strip().splitlines():
            label, keyword, pattern = line.split(" | ", 2)
            out.append((label, keyword, "(?s)" + pattern, priority, confidence))
    for name in SPDX:
        rule = r"(?<=spdx-license-identifier: ?[a-z0-9.+() -]{0,120})(?<=[ (:])" + name.replace(".", r"\.") + r"(?![a-z0-9-]|\.\d)"
        out.append((name, "spdx-license-identifier", rule, 5, 1.0))
    return out
