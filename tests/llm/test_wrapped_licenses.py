"""op2_license_scan finds notices that are broken over lines."""
import textwrap

from revtrace.llm import licenses

from .edge import PROSE, frame

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or"""


def test_broken_notices(spark):
    comment = "\n".join(" * " + x for x in GPL.split("\n"))
    narrow = "\n".join(textwrap.wrap(" ".join(MIT.split()), 30))
    long_ = "\n".join(textwrap.wrap(PROSE, 70))
    rows = [(200, BSD), (201, MIT), (202, GPL), (203, "/*\n" + comment + "\n */\nint x;"), (204, long_ + "\n" + narrow + "\n" + long_), (205, long_),
            (206, "Permission is hereby granted, free of charge,\n\n" + long_), (207, "Intro.\nReleased under the MIT License.\n" + long_)]
    notices = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_license, r.licenses, r.first_license) for r in licenses.license_scan(notices, licenses.train(frame(spark))).collect()}
    assert got[200] == (2, "BSD", 0) and got[201] == (1, "MIT", 0) and got[202] == (1, "GPL", 0)
    assert got[203][:2] == (1, "GPL") and got[204][:2] == (1, "MIT")
    assert got[205] == (0, "", None) and got[206] == (0, "", None) and got[207] == (1, "MIT", 1)


def test_keys():
    """No text reaches the least similarity to a template without a word of KEYS."""
    import re
    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        w = re.findall(licenses.TOKEN, text.lower())
        assert len(w) <= licenses.MOST_WORDS
        pairs = set(zip(w, w[1:]))
        assert sum(not set(b) & set(licenses.KEYS) for b in pairs) < licenses.SIMILAR * max(1, len(pairs))
