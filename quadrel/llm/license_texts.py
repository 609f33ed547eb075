"""Clauses of licence texts and notices, each with its label and the phrase that has to stand in it."""

from __future__ import annotations

# The base phrases, each its own key phrase; then (label, key phrase, clause), as the licences and
# their notices have them.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

CLAUSES = [
    ("afl-3.0", "academic free license", "Licensed under the Academic Free License version 3.0"),
    ("agpl", "gnu affero general public license", "under the terms of the GNU Affero General Public License"),
    ("agpl-3.0", "affero general public license", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache-1.1", "apache software foundation", "This product includes software developed by the Apache Software Foundation"),
    ("apache-2.0", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "on an as is basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0", "perpetual worldwide non exclusive", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of"),
    ("artistic-2.0", "artistic license", "under the terms of the Artistic License 2.0"),
    ("artistic-1.0", "semblance of artistic control", "such that the Copyright Holder maintains some semblance of artistic control over the development of the package"),
    ("beerware", "buy me a beer", "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return"),
    ("bsd", "source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "retain the above copyright notice", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "reproduce the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "endorse or promote products", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-4-clause", "all advertising materials", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsl-1.0", "boost software license", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "to any person or organization", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("busl-1.1", "business source license", "Use of this software is governed by the Business Source License"),
    ("cc0-1.0", "related or neighboring rights", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0", "cc0 1 0", "licensed under CC0 1.0 Universal"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC"),
    ("cc-by-nc", "creative commons attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "cc by nc nd", "Licensed under CC BY-NC-ND"),
    ("cc-by-nc-sa", "cc by nc sa", "Licensed under CC BY-NC-SA"),
    ("cc-by-nd", "cc by nd", "Licensed under CC BY-ND"),
    ("cc-by-nd", "creative commons attribution noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA"),
    ("cc-by-sa", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cddl-1.0", "common development and distribution license", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cecill-2.1", "cecill license", "This software is governed by the CeCILL license under French law"),
    ("cpl-1.0", "common public license", "under the terms of this Common Public License"),
    ("ecl-2.0", "educational community license", "Licensed under the Educational Community License, Version 2.0"),
    ("epl-2.0", "eclipse public license", "made available under the terms of the Eclipse Public License 2.0"),
    ("eupl-1.2", "european union public licence", "Licensed under the European Union Public Licence"),
    ("gfdl", "gnu free documentation license", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("gpl-2.0", "either version 2 of the license", "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0", "either version 3 of the license", "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "general public license version 2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "general public license version 3", "licensed under the GNU General Public License, version 3"),
    ("gpl-text", "gnu general public license", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-text", "without any warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("hpnd", "advertising or publicity pertaining", "not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the Independent JPEG Group"),
    ("isc", "with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("json", "for good not evil", "The Software shall be used for Good, not Evil."),
    ("lgpl", "gnu lesser general public license", "under the terms of the GNU Lesser General Public License"),
    ("lgpl-2.0", "gnu library general public license", "under the terms of the GNU Library General Public License"),
    ("mit", "mit license", "released under the MIT License"),
    ("mit-text", "hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-text", "included in all copies", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-text", "provided as is without warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mpl-1.1", "mozilla public license version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ms-pl", "microsoft public license", "Licensed under the Microsoft Public License"),
    ("mulan-psl-2.0", "mulan psl v2", "is licensed under Mulan PSL v2"),
    ("ncsa", "to deal with the software without restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction"),
    ("odbl-1.0", "open database license", "made available under the Open Database License"),
    ("ofl-1.1", "sil open font license", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("openssl", "openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("osl-3.0", "open software license", "Licensed under the Open Software License version 3.0"),
    ("php-3.01", "php license", "This source file is subject to version 3.01 of the PHP license"),
    ("postgresql", "without a written agreement is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("proprietary", "prior written permission of the", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("proprietary", "confidential and proprietary", "This document contains confidential and proprietary information"),
    ("public-domain", "into the public domain", "has been released into the public domain"),
    ("python-2.0", "python software foundation license", "Licensed under the Python Software Foundation License Version 2"),
    ("ruby", "ruby license", "distributed under the Ruby License"),
    ("sspl-1.0", "server side public license", "under the terms of the Server Side Public License, version 1"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "anyone is free to copy", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("wtfpl", "do what the fuck you want to", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("x11", "used in advertising", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software"),
    ("zlib", "as is without any express or implied warranty", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "must not be misrepresented", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zpl-2.1", "zope public license", "This software is subject to the provisions of the Zope Public License, Version 2.1"),
]
