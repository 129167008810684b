"""Notices by which texts name their licence, and sentences that speak of such matters without being a notice."""

# Wording of public licence notices, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License",
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": ["licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
    "Public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain",
    ],
    "Proprietary": [
        "All rights reserved",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher",
    ],
}

# Sentences that hold the same words and name no licence.
OTHER = [
    "The driver lost his licence after the accident",
    "A fishing license is required in this county",
    "Copyright law is a branch of private law",
    "She asked for permission to leave the room",
    "The warranty covers parts and labour for two years",
    "Civil rights were reserved for a few citizens in those days",
    "The license plate could not be read by the camera",
    "Restaurants need a license to sell alcohol",
    "He wrote a book about the history of copyright and the public",
    "Without a warrant the police may not search the house",
    "Version 2.0 of the program was released last week",
    "The general public may visit the gardens on Sundays",
]
