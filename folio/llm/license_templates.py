"""License notices that scans look for: public texts of notices and headers, the short forms that name a license, and
full license texts (license_texts/, whose origin is stated there)."""

from pathlib import Path

TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version.""",
    "LGPL-2.0": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Library General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Affero General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "MIT (named)": "Released under the MIT License.",
    "Apache-2.0 (named)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (named)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 (named)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (named)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 (named)": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details.""",
    "GPL-2.0 (named)": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0 (full name)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 (full name)": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 (full name)": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 (full name)": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "BSD-2-Clause (named)": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause (named)": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 (short)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (short)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 (short)": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 (short)": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 (short)": "Licensed under CC BY-NC-ND 4.0.",
}

#: Runs of words that tell a long notice from others of its kind; a match must have each of them, word for word.
REQUIRED: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL-2.0": ("terms of the GNU General Public License as published", "version 2 of"),
    "GPL-3.0": ("terms of the GNU General Public License as published", "version 3 of"),
    "LGPL-2.0": ("terms of the GNU Library General Public License as published", "version 2 of"),
    "LGPL-2.1": ("terms of the GNU Lesser General Public License as published", "version 2.1 of"),
    "LGPL-3.0": ("terms of the GNU Lesser General Public License as published", "version 3 of"),
    "AGPL-3.0": ("terms of the GNU Affero General Public License as published", "version 3 of"),
    "MPL-2.0": "Mozilla Public License, v. 2.0",
    "Apache-2.0 (full text)": "Apache License Version 2.0, January 2004",
    "CC0-1.0 (full text)": "CC0 1.0 Universal",
    "GFDL-1.2 (full text)": "Version 1.2, November 2002",
    "GFDL-1.3 (full text)": "Version 1.3, 3 November 2008",
    "GPL-1 (full text)": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2 (full text)": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3 (full text)": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2 (full text)": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1 (full text)": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3 (full text)": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-1.1 (full text)": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-2.0 (full text)": "Mozilla Public License Version 2.0",
}

TEMPLATES |= {f"{x.stem} (full text)": x.read_text("utf-8") for x in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
