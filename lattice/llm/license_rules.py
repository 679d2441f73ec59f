"""Hand-written license signatures, in order of priority.

A line is `license | keyword | regex`. A space in a regex stands for white space of any length. The keyword is a lower-case word that
every match of the regex contains: the prefilter. Sections set the priority: a lower number wins.
"""

RULES = r"""
# 1 tags
AGPL-3.0-or-later | spdx | SPDX-License-Identifier: AGPL-3\.0(-or-later|\+)
AGPL-3.0-only | spdx | SPDX-License-Identifier: AGPL-3\.0(-only)?\b
GPL-3.0-or-later | spdx | SPDX-License-Identifier: GPL-3\.0(-or-later|\+)
GPL-3.0-only | spdx | SPDX-License-Identifier: GPL-3\.0(-only)?\b
GPL-2.0-or-later | spdx | SPDX-License-Identifier: GPL-2\.0(-or-later|\+)
GPL-2.0-only | spdx | SPDX-License-Identifier: GPL-2\.0(-only)?\b
LGPL-3.0-or-later | spdx | SPDX-License-Identifier: LGPL-3\.0(-or-later|\+)
LGPL-3.0-only | spdx | SPDX-License-Identifier: LGPL-3\.0(-only)?\b
LGPL-2.1-or-later | spdx | SPDX-License-Identifier: LGPL-2\.1(-or-later|\+)
LGPL-2.1-only | spdx | SPDX-License-Identifier: LGPL-2\.1(-only)?\b
Apache-2.0 | spdx | SPDX-License-Identifier: Apache-2\.0
MIT | spdx | SPDX-License-Identifier: MIT\b
MIT-0 | spdx | SPDX-License-Identifier: MIT-0
ISC | spdx | SPDX-License-Identifier: ISC\b
BSD-2-Clause | spdx | SPDX-License-Identifier: BSD-2-Clause
BSD-3-Clause | spdx | SPDX-License-Identifier: BSD-3-Clause
MPL-2.0 | spdx | SPDX-License-Identifier: MPL-2\.0
EPL-2.0 | spdx | SPDX-License-Identifier: EPL-2\.0
EUPL-1.2 | spdx | SPDX-License-Identifier: EUPL-1\.2
CC0-1.0 | spdx | SPDX-License-Identifier: CC0-1\.0
CC-BY-4.0 | spdx | SPDX-License-Identifier: CC-BY-4\.0
CC-BY-SA-4.0 | spdx | SPDX-License-Identifier: CC-BY-SA-4\.0
CC-BY-NC-4.0 | spdx | SPDX-License-Identifier: CC-BY-NC-4\.0
Unlicense | spdx | SPDX-License-Identifier: Unlicense
Zlib | spdx | SPDX-License-Identifier: Zlib
BSL-1.0 | spdx | SPDX-License-Identifier: BSL-1\.0
WTFPL | spdx | SPDX-License-Identifier: WTFPL
OFL-1.1 | spdx | SPDX-License-Identifier: OFL-1\.1
Artistic-2.0 | spdx | SPDX-License-Identifier: Artistic-2\.0
PostgreSQL | spdx | SPDX-License-Identifier: PostgreSQL
Python-2.0 | spdx | SPDX-License-Identifier: (Python-2\.0|PSF-2\.0)
BUSL-1.1 | spdx | SPDX-License-Identifier: BUSL-1\.1
# 2 notices and license texts
Apache-2.0 | apache | licensed under the apache license,? (version|v\.?) ?2(\.0)?( \(the "?license"?\))?
Apache-1.1 | apache | apache software license,? version 1\.1
Apache-1.0 | apache | apache software license,? version 1\.0
GPL-3.0-only | gnu | licensed under the (terms of the )?gnu general public license,? version 3\b
GPL-2.0-only | gnu | licensed under the (terms of the )?gnu general public license,? version 2\b
GPL-3.0-or-later | gnu | gnu general public license as published by the free software foundation[,;]? either version 3 of the license,? or \(at your option\) any later version
GPL-2.0-or-later | gnu | gnu general public license as published by the free software foundation[,;]? either version 2 of the license,? or \(at your option\) any later version
LGPL-3.0-or-later | gnu | gnu lesser general public license as published by the free software foundation[,;]? either version 3 of the license,? or \(at your option\) any later version
LGPL-2.1-or-later | gnu | gnu lesser general public license as published by the free software foundation[,;]? either version 2\.1 of the license,? or \(at your option\) any later version
AGPL-3.0-or-later | gnu | gnu affero general public license as published by the free software foundation[,;]? either version 3 of the license,? or \(at your option\) any later version
GPL-3.0-only | gnu | under the terms of the gnu general public license version 3 only
GPL-2.0-only | gnu | under the terms of the gnu general public license version 2 only
MIT | permission | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | released | released under the (terms of the )?mit license
MIT | licensed | licensed under the (terms of the )?mit license
MIT | distributed | distributed under the (terms of the )?mit license
MIT | available | available under the (terms of the )?mit license
ISC | permission | permission to use, copy, modify,? and/?(or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
0BSD | permission | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.
BSD-Source-Code | redistribution | redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met
BSD-3-Clause | neither | neither the name of [\s\S]{1,200}? may be used to endorse or promote products derived from this software without specific prior written permission
BSD-4-Clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
BSD-2-Clause | licensed | licensed under the (simplified|2-clause) bsd license
BSD-3-Clause | licensed | licensed under the (modified|new|revised|3-clause) bsd license
BSD-Unspecified | licensed | licensed under the bsd license
BSL-1.0 | boost | distributed under the boost software license,? version 1\.0
MPL-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0
MPL-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1\.1
EPL-1.0 | eclipse | made available under the terms of the eclipse public license v1\.0
EPL-2.0 | eclipse | made available under the terms of the eclipse public license (v(ersion)? ?)?2\.0
CDDL-1.0 | common | subject to the terms of the common development and distribution license
Unlicense | unencumbered | this is free and unencumbered software released into the public domain
WTFPL | everyone | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
Zlib | software | this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable
PostgreSQL | permission | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
NTP | permission | permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted
HPND | permission | permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted
OFL-1.1 | font | this font software is licensed under the sil open font license,? version 1\.1
Artistic-2.0 | artistic | licensed under the artistic license,? (version )?2(\.0)?
CC-BY-NC-ND-4.0 | licensed | licensed under (a |the )?cc[ -]by-nc-nd[ -]4\.0
CC-BY-NC-SA-4.0 | licensed | licensed under (a |the )?cc[ -]by-nc-sa[ -]4\.0
CC-BY-NC-4.0 | licensed | licensed under (a |the )?cc[ -]by-nc[ -]4\.0
CC-BY-ND-4.0 | licensed | licensed under (a |the )?cc[ -]by-nd[ -]4\.0
CC-BY-SA-4.0 | licensed | licensed under (a |the )?cc[ -]by-sa[ -]4\.0
CC-BY-4.0 | licensed | licensed under (a |the )?cc[ -]by[ -]4\.0
CC-BY-NC-ND-4.0 | creative | licensed under (a |the )?creative commons attribution-non-?commercial-no-?deriv(ative)?s 4\.0 international( public)?( license)?
CC-BY-NC-SA-4.0 | creative | licensed under (a |the )?creative commons attribution-non-?commercial-share-?alike 4\.0 international( public)?( license)?
CC-BY-NC-4.0 | creative | licensed under (a |the )?creative commons attribution-non-?commercial 4\.0 international( public)?( license)?
CC-BY-SA-4.0 | creative | licensed under (a |the )?creative commons attribution-share-?alike 4\.0 international( public)?( license)?
CC-BY-ND-4.0 | creative | licensed under (a |the )?creative commons attribution-no-?derivatives 4\.0 international( public)?( license)?
CC-BY-4.0 | creative | licensed under (a |the )?creative commons attribution 4\.0 international( public)?( license)?
CC-BY-SA-3.0 | creative | licensed under (a |the )?creative commons attribution-share-?alike 3\.0( unported)?( license)?
CC-BY-3.0 | creative | licensed under (a |the )?creative commons attribution 3\.0( unported)?( license)?
CC0-1.0 | waive | has waived all copyright and related or neighboring rights
EUPL-1.2 | eupl | licensed under the eupl,? version 1\.2
EUPL-1.1 | eupl | licensed under the eupl,? version 1\.1
SSPL-1.0 | server | licensed under the server side public license,? (version|v) ?1
BUSL-1.1 | business | use of this software is governed by the business source license
Elastic-2.0 | elastic | licensed under the elastic license 2\.0
ODbL-1.0 | open | made available under the open database license
Proprietary | proprietary | proprietary and confidential
Proprietary | unauthorized | unauthorized (copying|use|distribution)[\s\S]{0,80}? is strictly prohibited
All-Rights-Reserved | rights | copyright [^\n]{0,80}all rights reserved
Public-Domain | dedicated | dedicated to the public domain
Public-Domain | placed | placed in the public domain
Public-Domain | released | released into the public domain
# 3 links
GPL-3.0 | gnu.org | https?://(www\.)?gnu\.org/licenses/gpl-3\.0(\.[a-z]+)?
GPL-2.0 | gnu.org | https?://(www\.)?gnu\.org/licenses/(old-licenses/)?gpl-2\.0(\.[a-z]+)?
LGPL-3.0 | gnu.org | https?://(www\.)?gnu\.org/licenses/lgpl-3\.0(\.[a-z]+)?
LGPL-2.1 | gnu.org | https?://(www\.)?gnu\.org/licenses/(old-licenses/)?lgpl-2\.1(\.[a-z]+)?
AGPL-3.0 | gnu.org | https?://(www\.)?gnu\.org/licenses/agpl-3\.0(\.[a-z]+)?
GFDL-1.3 | gnu.org | https?://(www\.)?gnu\.org/licenses/fdl-1\.3(\.[a-z]+)?
GPL-Unspecified | gnu.org | https?://(www\.)?gnu\.org/licenses/?
Apache-2.0 | apache.org | https?://(www\.)?apache\.org/licenses/LICENSE-2\.0(\.[a-z]+)?
Apache-1.1 | apache.org | https?://(www\.)?apache\.org/licenses/LICENSE-1\.1(\.[a-z]+)?
MIT | opensource.org | https?://(www\.)?opensource\.org/licen[sc]es?/MIT(\.php)?
ISC | opensource.org | https?://(www\.)?opensource\.org/licen[sc]es?/ISC
BSD-3-Clause | opensource.org | https?://(www\.)?opensource\.org/licen[sc]es?/BSD-3-Clause
BSD-2-Clause | opensource.org | https?://(www\.)?opensource\.org/licen[sc]es?/BSD-2-Clause
Apache-2.0 | opensource.org | https?://(www\.)?opensource\.org/licen[sc]es?/Apache-2\.0
Artistic-2.0 | opensource.org | https?://(www\.)?opensource\.org/licen[sc]es?/artistic-license-2\.0
MPL-2.0 | mozilla.org | https?://(www\.)?mozilla\.org/(en-US/)?MPL/2\.0/?
MPL-1.1 | mozilla.org | https?://(www\.)?mozilla\.org/(en-US/)?MPL/1\.1/?
EPL-2.0 | eclipse.org | https?://(www\.)?eclipse\.org/legal/epl-(2\.0|v20)(\.html)?
EPL-1.0 | eclipse.org | https?://(www\.)?eclipse\.org/legal/epl-v10(\.html)?
BSL-1.0 | boost.org | https?://(www\.)?boost\.org/LICENSE_1_0\.txt
Unlicense | unlicense.org | https?://unlicense\.org/?
WTFPL | wtfpl.net | https?://(www\.)?wtfpl\.net/?
CC0-1.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
CC-PDDC | creativecommons.org | https?://(www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
CC-BY-4.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by/4\.0/?
CC-BY-3.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by/3\.0/?
CC-BY-2.5 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by/2\.5/?
CC-BY-2.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by/2\.0/?
CC-BY-SA-4.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-SA-3.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-SA-2.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-sa/2\.0/?
CC-BY-NC-4.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-NC-3.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nc/3\.0/?
CC-BY-NC-SA-4.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-SA-3.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nc-sa/3\.0/?
CC-BY-NC-ND-4.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-NC-ND-3.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nc-nd/3\.0/?
CC-BY-ND-4.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-ND-3.0 | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/by-nd/3\.0/?
CC-Unspecified | creativecommons.org | https?://(www\.)?creativecommons\.org/licenses/?
EUPL-1.2 | europa.eu | https?://[a-z.]*europa\.eu/[^\s]{0,80}eupl[^\s]{0,40}
OFL-1.1 | sil.org | https?://(scripts|www)\.sil\.org/OFL
ODbL-1.0 | opendatacommons.org | https?://(www\.)?opendatacommons\.org/licenses/odbl(/1-0|/1\.0)?/?
ODC-By-1.0 | opendatacommons.org | https?://(www\.)?opendatacommons\.org/licenses/by(/1-0|/1\.0)?/?
PDDL-1.0 | opendatacommons.org | https?://(www\.)?opendatacommons\.org/licenses/pddl(/1-0|/1\.0)?/?
BUSL-1.1 | mariadb.com | https?://(www\.)?mariadb\.com/bsl11/?
PHP-3.01 | php.net | https?://(www\.)?php\.net/license/3_01\.txt
# 4 names with a version
AGPL-3.0 | affero | (gnu )?affero general public license,? \(?(version|v\.?) ?3(\.0)?\)?
AGPL-1.0 | affero | affero general public license,? (version|v\.?) ?1(\.0)?
LGPL-3.0 | lesser | (gnu )?lesser general public license,? \(?(version|v\.?) ?3(\.0)?\)?
LGPL-2.1 | lesser | (gnu )?lesser general public license,? \(?(version|v\.?) ?2\.1\)?
LGPL-2.0 | library | (gnu )?library general public license,? \(?(version|v\.?) ?2(\.0)?\)?
GPL-3.0 | general | (gnu )?general public license,? \(?(version|v\.?) ?3(\.0)?\)?
GPL-2.0 | general | (gnu )?general public license,? \(?(version|v\.?) ?2(\.0)?\)?
GPL-1.0 | general | (gnu )?general public license,? \(?(version|v\.?) ?1(\.0)?\)?
GFDL-1.3 | documentation | (gnu )?free documentation license,? (version|v\.?) ?1\.3
GFDL-1.2 | documentation | (gnu )?free documentation license,? (version|v\.?) ?1\.2
GFDL-1.1 | documentation | (gnu )?free documentation license,? (version|v\.?) ?1\.1
GPL-3.0 | gpl | \bgplv?-?3(\.0)?\b
GPL-2.0 | gpl | \bgplv?-?2(\.0)?\b
LGPL-3.0 | lgpl | \blgplv?-?3(\.0)?\b
LGPL-2.1 | lgpl | \blgplv?-?2\.1\b
AGPL-3.0 | agpl | \bagplv?-?3(\.0)?\b
Apache-2.0 | apache | apache (software )?license,? \(?(version|v\.?)? ?2(\.0)?\)?
Apache-2.0 | apache-2.0 | \bapache-2\.0\b
MPL-2.0 | mozilla | mozilla public license,? \(?(version|v\.?)? ?2\.0\)?
MPL-1.1 | mozilla | mozilla public license,? \(?(version|v\.?)? ?1\.1\)?
MPL-1.0 | mozilla | mozilla public license,? \(?(version|v\.?)? ?1\.0\)?
MPL-2.0 | mpl-2.0 | \bmpl-2\.0\b
EPL-2.0 | eclipse | eclipse public license,? (-|version|v\.?)? ?2\.0
EPL-1.0 | eclipse | eclipse public license,? (-|version|v\.?)? ?1\.0
EUPL-1.2 | european | european union public licen[cs]e,? (version|v\.?) ?1\.2
EUPL-1.1 | european | european union public licen[cs]e,? (version|v\.?) ?1\.1
CDDL-1.1 | common | common development and distribution license,? \(?(cddl\) )?(version|v\.?) ?1\.1
CDDL-1.0 | common | common development and distribution license,? \(?(cddl\) )?(version|v\.?) ?1\.0
CPL-1.0 | common | common public license,? (version|v\.?)? ?1\.0
CPAL-1.0 | common | common public attribution license,? (version|v\.?)? ?1\.0
BSL-1.0 | boost | boost software license,? (-|version|v\.?)? ?1\.0
Artistic-2.0 | artistic | artistic license,? (version|v\.?)? ?2(\.0)?
Artistic-1.0 | artistic | artistic license,? (version|v\.?)? ?1(\.0)?
OFL-1.1 | open | (sil )?open font license,? (version|v\.?)? ?1\.1
OSL-3.0 | open | open software license,? (version|v\.?)? ?3\.0
AFL-3.0 | academic | academic free license,? (version|v\.?)? ?3\.0
ECL-2.0 | educational | educational community license,? (version|v\.?)? ?2\.0
MS-PL | microsoft | microsoft public license
MS-RL | microsoft | microsoft reciprocal license
LPPL-1.3c | latex | latex project public license,? (version|v\.?)? ?1\.3c?
PHP-3.01 | license | php license,? (version|v\.?)? ?3\.01
Python-2.0 | python | python software foundation license,? (version|v\.?)? ?2
Ruby | license | distributed under the ruby license
CECILL-2.1 | cecill | cecill(-| free software license agreement,? (version|v\.?)) ?2\.1
SSPL-1.0 | server | server side public license,? (version|v\.?)? ?1
BUSL-1.1 | business | business source license,? (version|v\.?)? ?1\.1
Elastic-2.0 | elastic | elastic license,? (version|v\.?)? ?2(\.0)?
CC-BY-NC-ND-4.0 | by-nc-nd | \bcc by-nc-nd 4\.0
CC-BY-NC-SA-4.0 | by-nc-sa | \bcc by-nc-sa 4\.0
CC-BY-NC-4.0 | by-nc | \bcc by-nc 4\.0
CC-BY-ND-4.0 | by-nd | \bcc by-nd 4\.0
CC-BY-SA-4.0 | by-sa | \bcc by-sa 4\.0
CC-BY-SA-3.0 | by-sa | \bcc by-sa 3\.0
CC-BY-4.0 | 4.0 | \bcc by 4\.0
CC-BY-3.0 | 3.0 | \bcc by 3\.0
CC-BY-NC-ND-4.0 | cc-by-nc-nd | \bcc-by-nc-nd-4\.0
CC-BY-NC-SA-4.0 | cc-by-nc-sa | \bcc-by-nc-sa-4\.0
CC-BY-NC-4.0 | cc-by-nc | \bcc-by-nc-4\.0
CC-BY-ND-4.0 | cc-by-nd | \bcc-by-nd-4\.0
CC-BY-SA-4.0 | cc-by-sa | \bcc-by-sa-4\.0
CC-BY-4.0 | cc-by | \bcc-by-4\.0
CC-BY-NC-ND-4.0 | creative | creative commons attribution-non-?commercial-no-?deriv(ative)?s 4\.0
CC-BY-NC-SA-4.0 | creative | creative commons attribution-non-?commercial-share-?alike 4\.0
CC-BY-NC-4.0 | creative | creative commons attribution-non-?commercial 4\.0
CC-BY-SA-4.0 | creative | creative commons attribution-share-?alike 4\.0
CC-BY-SA-3.0 | creative | creative commons attribution-share-?alike 3\.0
CC-BY-4.0 | creative | creative commons attribution 4\.0
CC-BY-3.0 | creative | creative commons attribution 3\.0
CC0-1.0 | cc0 | \bcc0(-| )1\.0\b
CC0-1.0 | creative | creative commons (cc0|zero)( 1\.0)?( universal)?
# 5 names without a version
AGPL-Unspecified | affero | (gnu )?affero general public license
LGPL-Unspecified | lesser | (gnu )?lesser general public license
LGPL-Unspecified | library | (gnu )?library general public license
GPL-Unspecified | gnu | gnu general public license
GFDL-Unspecified | gnu | gnu free documentation license
Apache-Unspecified | apache | apache (software |public )?license
MIT | license | \bmit license
MIT | license | \bexpat license
MIT-0 | attribution | mit no attribution
BSD-2-Clause | license | (2-clause|two-clause|simplified|freebsd) bsd license
BSD-3-Clause | license | (3-clause|three-clause|modified|new|revised) bsd license
BSD-4-Clause | license | (4-clause|four-clause|original) bsd license
BSD-2-Clause | bsd-2-clause | \bbsd-2-clause\b
BSD-3-Clause | bsd-3-clause | \bbsd-3-clause\b
BSD-Unspecified | license | \bbsd license
ISC | license | \bisc license
Zlib | license | \bzlib(/libpng)? license
Unlicense | unlicense | the unlicense\b
WTFPL | wtfpl | \bwtfpl\b
WTFPL | fuck | do what the fuck you want to public license
MPL-Unspecified | mozilla | mozilla public license
EPL-Unspecified | eclipse | eclipse public license
EUPL-Unspecified | european | european union public licen[cs]e
CDDL-Unspecified | common | common development and distribution license
BSL-1.0 | boost | boost software license
Artistic-Unspecified | artistic | artistic license
PostgreSQL | postgresql | postgresql licen[cs]e
OFL-Unspecified | open | (sil )?open font license
ODbL-Unspecified | open | open database license
Beerware | license | beer-?ware license
NCSA | illinois | university of illinois/ncsa open source license
W3C | license | w3c software (notice and )?license
Vim | license | \bvim license
TCL | license | \btcl/tk license
OpenSSL | license | openssl license
PHP-Unspecified | license | \bphp license
Python-Unspecified | python | python software foundation license
LPPL-Unspecified | latex | latex project public license
JSON | software | the software shall be used for good, not evil
Proprietary | commercial | commercial license agreement
EULA | agreement | end[ -]user license agreement
CC-Unspecified | creative | (under|using) (a |the )?creative commons licen[cs]e
All-Rights-Reserved | reserved | \ball rights reserved\b
"""
