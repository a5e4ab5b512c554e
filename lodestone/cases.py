"""A corpus with a known answer: for each row of a table one of these files, with the row's number in its names.

Each case shows one check or structure by what must be found and by what must not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS = "".join(f"    row = pick(row, {1000 + k}, 'a column of the table that is kept as is')\n" for k in range(60))

#: Name -> code; ``<u>`` stands for the row's number.
CASES: dict[str, str] = {
    "imports": "import subprocess, marshal\nfrom shelve import open as o\nimport yaml.nodes\nfrom telnetlib import Telnet\nimport ftplib\nimport ctypes\nimport os.path\nimport json\nfrom . import pickle\n",
    "dynamic": "x = exec(code_<u>)\nm = __import__(name)\nn = __import__('json')\ndef evaluate(a):\n    return a\nevaluate(1)\n",
    "sql_inline": (
        "def f_<u>(cur, a, args):\n    cur.execute('SELECT x FROM t WHERE a = %s', (a,))\n    cur.execute('SELECT a FROM t WHERE a = ' + a)\n    cur.execute('DELETE FROM t WHERE a = {}'.format(a))\n"
        "    cur.execute(f'DROP TABLE {a}')\n    cur.execute('SELECT 1')\n    cur.executemany('UPDATE t SET a = %d' % a)\n    cur.fetch('SELECT ' + a)\n    cur.execute('SELECT b FROM t WHERE b = ' + args)\n"
    ),
    "sql_variable": "def g_<u>(cur, a):\n    q = 'SELECT x FROM t WHERE y = ' + a\n    cur.execute(q)\n    p = 'SELECT x FROM t WHERE y = ?'\n    cur.execute(p, (a,))\n    s = 'INSERT INTO t VALUES (' + a\n    s = s + ')'\n    cur.execute(s)\n    z = 'plain ' + a\n    cur.execute(z)\n",
    "shell": "import os\nos.system('ls')\nos.popen(cmd_<u>)\nsubprocess.run(cmd, shell=True)\nsubprocess.run(cmd, shell=False)\nsubprocess.run(['a'])\ncommands.getoutput('x')\nsystem('ls')\n",
    "secrets": (
        "password = 'hunter<u>'\nAPI_KEY = 'k<u>'\napi-key = 'z'\nsecret = 'short'\nsecret = 'long enough <u>'\ntoken = \"abcdefgh<u>\"\npassword = os.environ['x'] or 'y'\npassword = 'your_password'\n"
        "password = f'{a}'\nuser_password='x' # token = 'abcdefghij'\n"
    ),
    "valid_secrets": "password = 'hunter<u>'\napi_key = 'k<u>'\nsecret = 'long enough <u>'\ntoken = 'test token value'\nmy_token = 'abcdefgh<u>'\n",
    "hashes": "hashlib.md5(x)\nhashlib.sha1(x)\nhashlib.sha256(x)\nMD5_of(x)\nmd5 = 1\nnew_sha1_md5(x_<u>)\n",
    "pickles": "pickle.load(f)\ncPickle.loads(f)\nyaml.load(f, Loader=yaml.SafeLoader)\nyaml.safe_load(f)\nyaml.unsafe_load(f_<u>)\npickle.dump(x, f)\n",
    "randoms": "a = 1\nb = random.choice(x)\nc = 2\n\n\n\nkey_<u> = random.random()\n\n\n\n\nd = random.random()\n\n\n\ntoken = 3\nrandrange(5)\n",
    "paths": "open(name_<u>)\nopen('a.txt')\nopen(NAME)\nos.path.join(base, 'x')\nopen(f'{a}')\nopen(self.path)\npathlib.Path(a + 'b')\nopen(get())\nreopen(name)\nopen('a', mode)\n",
    "xml": "xml.etree.ElementTree.parse(f)\nET.parse(f_<u>)\nxml.sax.parseString(s)\nxml.dom.minidom.Document()\nlxml.etree.fromstring(s)\n",
    "races": "if os.path.exists(p):\n    open('a')\nif os.path.isfile(p):\n    a()\n    b()\n    c()\n    d()\n    os.remove(p)\nif os.access(p_<u>, 1):\n    pass\n\n\n\n\n\n\nos.unlink(p)\n",
    "temps": "tempfile.mktemp()\ntempfile.mkstemp()\nos.tmpnam()\nos.tempnam(x_<u>)\n",
    "sizes": "a = bytearray(n * 4)\nb = list(range(n ** 2))\nc = n * 2\nd = bytes(n + 1)\ne = len(list(n_<u> * 2))\n",
    "formats": "fmt_<u>.format(x)\n'a{}'.format(x)\nget().format(x)\n('a' + b).format(x)\nself.f.format(x)\nformat(x)\n",
    "redirects": "redirect(url_<u>)\nredirect('/home')\nflask.redirect(get_url())\nRedirectView(a + b)\nredirect(self.url)\n",
    "timings": "if token == given:\n    pass\nif token == None:\n    pass\nif hmac.compare_digest(token, given) == other_token:\n    pass\nif user.password != b:\n    pass\nif x == y:\n    pass\nif token > b:\n    pass\nif (auth_<u>\n        == b):\n    pass\n",
    "loops": "while True:\n    sock.recv(1)\nwhile True:\n    pass\nwhile x_<u>:\n    sock.recv(1)\nwhile True:\n    if a:\n        b = fetch_all()\n",
    "modes": "os.chmod(p, 0o777)\nos.chmod(p, 0o600)\nos.fchmod(f, 0o620)\nos.chmod(p, mode)\nos.chmod(p_<u>, 0o644)\nchmod(p, 0o777)\n",
    "requests": "requests.get(url_<u>)\nrequests.get('http://x')\nurllib.request.urlopen(base + u)\nrequests.post(self.url)\nrequests.put(u)\nrequests.get()\n",
    "privileges": (
        "def f_<u>(role, b):\n    return role\ndef g(user_role):\n    if user_role == 'a':\n        return 1\nasync def h(role):\n    return 1\ndef k(*, role):\n    return 1\ndef m(access_level, permission):\n    assert access_level\n    return 1\n"
        "def n(level):\n    raise Bad(level)\n"
    ),
    "structure": (
        "import os\nfrom enum import Enum\n\n\n@dataclass\nclass Cart_<u>(Base):\n    \"\"\"Holds what a user wants to buy.\"\"\"\n\n    def __init__(self, owner: str, limit: int = 5):\n        self.owner = owner\n\n"
        "    @property\n    def total(self) -> float:\n        return total_of(self.items)\n\n\nclass Color(Enum):\n    RED = 1\n\n\n"
        "def outer_<u>(a: int, *rest: str, key=None, **more: dict) -> list[int]:\n    \"\"\"Walks all rows.\"\"\"\n    def inner(x):\n        return helper.run(x)\n    with open('a') as f, lock():\n        try:\n            load(f)\n"
        "        except ValueError:\n            recover(f)\n    for i in rest:\n        while i and a or key:\n            if i:\n                i = inner(i)\n    return f\n\n\nasync def fetch(url):\n    await get(url)\n\n\nif __name__ == \"__main__\":\n    outer_<u>(1)\n"
    ),
    "long_function": "import re\n\n\ndef long_<u>(row):\n" + _ROWS + "    return row\n",
    "broken": "import re\n\nclass Half_<u>:\n    def one(self):\n        return 1\n\ndef two(a:\n    return a\n\ndef three(b):\n    \"\"\"Third of them.\"\"\"\n    return b\n",
    "plain": "a = 1\nb = a + <u>\nprint(b)\n",
    "empty": "",
}
NAMES = tuple(CASES)


def case_corpus(rows: DataFrame, id_col: str) -> DataFrame:
    """``(file_id, path, code, code_hash)``: row ``i`` has the case of number ``i`` modulo their count."""
    i = F.col(id_col).cast("long")
    codes = F.element_at(F.array(*[F.lit(c) for c in CASES.values()]), (F.pmod(i, F.lit(len(NAMES))) + 1).cast("int"))
    code = F.replace(codes, F.lit("<u>"), i.cast("string"))
    path = F.concat(F.lit("src/"), F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod(i, F.lit(len(NAMES))) + 1).cast("int")), F.lit(".py"))
    return rows.select(i.alias("file_id"), path.alias("path"), code.alias("code"), F.sha2(code, 256).alias("code_hash"))
