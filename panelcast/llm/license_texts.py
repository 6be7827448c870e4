"""Texts by which headers and licence files are recognised: (licence, words a block must have, text).

The required words tell apart texts that differ in a name or a version only. Licences of thousands of words stand with
their opening passage and the notice that they ask for.
"""

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)


def gnu_notice(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


def gnu_title(name: str, version: str, date: str, years: str) -> str:
    return (
        f"GNU {name} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, "
        "but changing it is not allowed."
    )


GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
BLOCKS = [
    ("MIT", "", MIT_GRANT + MIT_REST),
    ("MIT", "", MIT_GRANT),
    ("MIT", "permission hereby granted obtaining", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "endorse promote", BSD_GRANT + BSD_TWO + BSD_THIRD + BSD_REST),
    ("BSD-2-Clause", "redistributions reproduce", BSD_GRANT + BSD_TWO + BSD_REST),
    ("BSD-3-Clause", "redistribution binary modification", BSD_GRANT),
    ("Apache-2.0", "apache 2.0", APACHE_NOTICE),
    ("Apache-2.0", "apache", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("Apache-2.0", "licensed apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "general 2", gnu_notice(GPL, "2")),
    ("GPL-3.0", "general 3", gnu_notice(GPL, "3")),
    ("LGPL-2.1", "lesser 2.1", gnu_notice(LGPL, "2.1")),
    ("LGPL-3.0", "lesser 3", gnu_notice(LGPL, "3")),
    ("AGPL-3.0", "affero 3", gnu_notice(AGPL, "3")),
    ("GPL-2.0", "general 2", gnu_title(GPL, "2", "June 1991", "1989, 1991")),
    ("GPL-3.0", "general 3", gnu_title(GPL, "3", "29 June 2007", "2007")),
    ("LGPL-2.1", "lesser 2.1", gnu_title(LGPL, "2.1", "February 1999", "1991, 1999")),
    ("LGPL-3.0", "lesser 3", gnu_title(LGPL, "3", "29 June 2007", "2007")),
    ("AGPL-3.0", "affero 3", gnu_title(AGPL, "3", "19 November 2007", "2007")),
    ("GPL-2.0", "licensed gnu general license 2", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed gnu general license 3", "licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "licensed gnu lesser license 3", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed gnu affero license 3", "licensed under the GNU Affero General Public License, version 3"),
    (
        "MPL-2.0", "mozilla",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "mozilla license 2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MIT", "licensed mit license", "licensed under the MIT License"),
    ("MIT", "released mit license", "released under the MIT License"),
    ("MIT", "distributed mit license", "distributed under the MIT License"),
    ("CC-BY-4.0", "licensed creative commons attribution 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed commons attribution-sharealike 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed commons attribution-noncommercial 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "licensed cc by 4.0", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "licensed cc by-sa 4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "licensed cc by-nc 4.0", "licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "waived copyright", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    (
        "Unlicense", "unencumbered",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
]
#: Names that stand for a licence of the list in SPDX lines; others are kept as they are written.
SPDX = {name.lower(): name for name, _, _ in BLOCKS}
SPDX |= {f"{name.lower()}{end}": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("-only", "-or-later", "+")}
