"""Notices of public licences, and sentences that only sound like one.

The templates are the usual notice lines and opening paragraphs, lower case and
without names and years.  ``ORDINARY`` trains the class of no licence.
"""

TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "licensed under the apache license, version 2.0",
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
        "released under the apache license 2.0",
        "spdx-license-identifier: apache-2.0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "released under the bsd 3-clause license",
        "licensed under the bsd license",
        "this code is distributed under the 2-clause bsd licence",
        "spdx-license-identifier: bsd-3-clause",
    ],
    "cc": [
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by-nc 4.0",
        "licensed under cc by-sa 4.0",
        "licensed under cc by 4.0",
        "this work is licensed under the creative commons attribution-noncommercial-sharealike 4.0 international license",
        "content is available under creative commons attribution-sharealike",
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under cc0 1.0 universal",
        "released under cc0 1.0",
        "spdx-license-identifier: cc-by-4.0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license, version 3",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program",
        "licensed under the gnu gpl version 2",
        "released under the gpl v3",
        "spdx-license-identifier: gpl-3.0-or-later",
    ],
    "agpl": [
        "licensed under the gnu affero general public license, version 3",
        "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "released under the agpl v3",
        "spdx-license-identifier: agpl-3.0-only",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license, version 2.1",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "released under the lgpl v2.1 or later",
        "spdx-license-identifier: lgpl-2.1-or-later",
    ],
    "isc": [
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "released under the isc license",
        "licensed under the isc licence",
        "spdx-license-identifier: isc",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "this project is available under the terms of the mit licence",
        "spdx-license-identifier: mit",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0",
        "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0",
        "licensed under the mozilla public license, version 2.0",
        "spdx-license-identifier: mpl-2.0",
    ],
    "proprietary": [
        "copyright. all rights reserved",
        "all rights reserved. no part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the copyright owner",
        "this software is proprietary and confidential. unauthorized copying of this file, via any medium, is strictly prohibited",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "this work is released into the public domain",
    ],
}

ORDINARY: list[str] = [
    "a driving license is required to rent a car in most countries",
    "the restaurant lost its liquor license last year after a dispute with the council",
    "she holds a license to practise medicine in three states",
    "copyright law is a field that students often find hard",
    "the court decided that the copyright had expired long ago",
    "the warranty of this washing machine covers two years",
    "visitors need permission to enter the building after six",
    "the apache helicopter landed on the roof",
    "the apache people lived in the southwest",
    "he studied physics at mit and later moved to london",
    "the public domain of the city includes its parks and squares",
    "the software was distributed to every school in the district",
    "the commons were open to the sheep of the whole village",
    "creative people in common rooms like to talk",
    "fishing without a license is punished with a fine",
    "the general public was not allowed into the hall",
    "the mozilla team met in berlin",
    "the ministry published the terms of the agreement",
    "rights and duties go together, the teacher said",
    "the plate of the car and the license of its owner were checked",
    "they licensed their songs to a film studio for a large sum",
    "a software license costs about as much as a laptop",
    "the version that we have is older than the one in the shop",
    "the notice on the door said that the shop was closed",
    "free entry for children under six years of age",
    "the distribution of the population has changed since the war",
    "source and binary stars are studied by astronomers",
    "the foundation gave money to a free clinic",
]
