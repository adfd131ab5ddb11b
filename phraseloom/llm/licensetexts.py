"""Headers, titles and full texts of licenses: fixed values of license scans.

The full texts are the files of ``license_texts``, named by license, without
the appendices that say how to apply them. No file holds the text of AGPL-3.0;
that of GPL-3.0 under the other name stands for it.
"""

from __future__ import annotations

from pathlib import Path

GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the"
    " Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is"
    " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY"
    " or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name}"
    " along with this {what}; if not,"
)
GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
HEADERS = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        ' to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF'
        " ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", GNU.format(what="program", name=GPL, version="2")),
    ("GPL-3.0", GNU.format(what="program", name=GPL, version="3")),
    ("LGPL-2.1", GNU.format(what="library", name=LGPL, version="2.1")),
    ("LGPL-3.0", GNU.format(what="library", name=LGPL, version="3")),
    ("AGPL-3.0", GNU.format(what="program", name=AGPL, version="3")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)
# Lines that name a license and say no more.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("LGPL", "GNU Lesser General Public License"),
    ("AGPL", "GNU Affero General Public License"),
    ("GPL", "GNU General Public License"),
    ("GPL", "it under the terms of the GNU General Public License as published by"),
)
# What a text must hold to have the license: these words, as far as the
# template has them. Other words are common to several licenses.
NAMES = {
    "Apache-2.0": "apache",
    "MIT": "mit sublicense",
    "GPL-2.0": "gnu general public 2",
    "GPL-3.0": "gnu general public 3",
    "LGPL-2.1": "gnu lesser public 2 1",
    "LGPL-3.0": "gnu lesser public 3",
    "AGPL-3.0": "gnu affero public 3",
    "BSD-2-Clause": "redistribution redistributions",
    "BSD-3-Clause": "redistribution endorse",
    "MPL-2.0": "mozilla",
    "CC0-1.0": "cc0",
    "CC-BY-4.0": "cc by",
    "CC-BY-SA-4.0": "cc by sa",
    "CC-BY-NC-4.0": "cc by nc",
    "ISC": "fee",
}


def texts() -> tuple[tuple[str, str], ...]:
    folder = Path(__file__).with_name("license_texts")
    found = {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in sorted(folder.glob("*.txt"))}
    gpl = found["GPL-3.0"]
    found["AGPL-3.0"] = gpl.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL", "GNU AFFERO GENERAL")
    return tuple(found.items())
