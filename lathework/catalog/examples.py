"""A small literal change set, for queries whose findings the tables may lack.

Each file has shapes that a scanner must find.  Queries that name this module
read it together with the whole table of changed files, in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPOSITORY, SHA = "example/shapes", "0" * 40

_SHARED = """total = sum(item.price for item in basket)
discount = lookup_discount(customer, total)
shipping = shipping_cost(basket.weight, customer.country)
invoice = Invoice(customer, total - discount + shipping)
invoice.send(customer.address)
archive(invoice)"""

#: (name, lines of the new side)
_TEXTS = [
    ("app/jobs.py", """import pandas as pd
async def refresh(users):
    for user in users:
        row = session.query(User, user)
    requests.get(url)
    names = ''
    for user in users:
        names += 'x'
    rows = 'SELECT * FROM accounts'
    text = json.dumps(Order.objects.all())
    first = [u for u in users if u.ok][0]
    return Order.objects.filter(a=1).all()
    print(first)"""),
    ("web/list.jsx", """users.map((u) =>
  prisma.user.find(u))
const kept = rows.filter(r =>
   wanted.includes(r))
window.addEventListener('resize', draw)
setInterval(poll, 100)
const a = <Chart style={{ width: 3 }} />
const b = <Button onClick={() => go(1)} />
throw new Error('x');

drawn = true"""),
    ("svc/worker.go", """func run(jobs []Job) {
	for _, j := range jobs {
		go handle(j)
	}
	go func() { poll() }()
	return
	cleanup()
}"""),
    ("core/store.rs", "let a = b.clone();\nlet c = f(a.clone(), 1);"),
    ("db/migrations/0007_orders.sql", """DROP TABLE IF EXISTS old_orders;
ALTER TABLE orders DROP COLUMN note;
TRUNCATE TABLE sessions;
ALTER TABLE orders ALTER COLUMN total TYPE numeric;
ALTER TABLE orders RENAME TO sales;
ALTER TYPE mood ADD VALUE 'calm';
UPDATE orders SET total = 0;
ALTER TABLE items ADD CONSTRAINT fk FOREIGN KEY (order_id) REFERENCES orders;"""),
    ("shop/cart.py", _SHARED),
    ("shop/checkout.py", "def pay(basket, customer):\n" + "\n".join("    " + x for x in _SHARED.split("\n"))),
    ("shop/legacy.py", _SHARED + "\nlog(invoice)"),
    ("tools/exits.py", """def a():
    return
    b = 2
def c():
    raise

    d = 3
def e():
    os.Exit(1)
    f = 4
def g():
    return (1)
    h = 5
def k():
    panic('x')
    m = 6"""),
    ("LICENSE", "GNU General Public License version 3, 29 June 2007\nEveryone may copy it."),
    ("third/COPYING", "Mozilla Public License Version 2.0"),
    ("docs/license.md", "MIT License"),
    ("ext/LICENSE.md", "Server Side Public License"),
    ("lib/COPYING.txt", "Copyright\nBSD 3-Clause"),
    ("web/package.json", """{
  "name": "web",
  "license": "AGPL-3.0",
  "left-pad": "latest",
  "event-stream": "3.3.6",
  "own-fork": "github:someone/fork",
  "react": "^18.0.0",
  "moment": "*"
}"""),
    ("crates/Cargo.toml", '[package]\nlicense = "SSPL-1.0"\nversion = "1.0.0"'),
    ("pyproject.toml", '[project]\nlicense = {file = "x", text = "Proprietary"}\nlicense = "MIT"'),
    ("requirements.txt", "numpy\npandas>=2.0\nurllib3==1.26\nPyYAML"),
]

#: file_id, repo_full_name, pr_number, head_sha, file_ord, filename, status, additions, deletions, patch
ROWS = [
    (-i, REPOSITORY, 1, SHA, i, name, "added", text.count("\n") + 1, 0, f"@@ -0,0 +1,{text.count(chr(10)) + 1} @@\n" + "\n".join("+" + x for x in text.split("\n")))
    for i, (name, text) in enumerate(_TEXTS, 1)
]

SCHEMA = "file_id bigint, repo_full_name string, pr_number int, head_sha string, file_ord int, filename string, status string, additions int, deletions int, patch string"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{x}::{'BIGINT' if k == 0 else 'INT'}" if isinstance(x, int) else quoted(x) for k, x in enumerate(row)) + ")" for row in ROWS) + ") AS e(" + ", ".join(c.split()[0] for c in SCHEMA.split(", ")) + ")"


def example_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


#: Comments of a review, some of them replies: comment_id, author, path, body, reply_to, likes, dislikes.
COMMENTS = [
    (1, "review-helper[bot]", "a.py", "[CRITICAL] SQL injection in the query", None, 1, 0),
    (2, "ada", "a.py", "Good catch, fixed in the next unit", 1, 0, 0),
    (3, "review-helper[bot]", "b.py", "[WARNING] slow: no index on this column", None, 2, 0),
    (4, "ben", "b.py", "thanks", 3, 0, 0),
    (5, "review-helper[bot]", "c.py", "[SUGGESTION] extract this pattern", None, 0, 3),
    (6, "review-helper[bot]", "d.py", "[INFO] missing test coverage", None, 0, 0),
    (7, "cai", "d.py", "This is by design.", 6, 0, 0),
    (8, "review-helper[bot]", "e.py", "possible null dereference", None, 0, 0),
    (9, "ben", "e.py", "[WARNING] I disagree", 8, 0, 0),
    (10, "ada", "f.py", "Could we rename this?", None, 5, 0),
    (11, "dee", "f.py", "Sure", 10, 0, 0),
    (12, "review-helper[bot]", "g.py", "[WARNING] memory leak", None, 1, 0),
    (13, "ada", "g.py", "first reply", 12, 0, 0),
    (14, "ben", "g.py", "second reply", 12, 0, 0),
]
COMMENT_SCHEMA = "comment_id bigint, author string, path string, body string, reply_to bigint, likes int, dislikes int"
COMMENT_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::BIGINT" if x is None else (f"{x}::{'INT' if k > 4 else 'BIGINT'}" if isinstance(x, int) else quoted(x)) for k, x in enumerate(row)) + ")" for row in COMMENTS) + ") AS e(" + ", ".join(c.split()[0] for c in COMMENT_SCHEMA.split(", ")) + ")"


def example_comments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMENTS, COMMENT_SCHEMA)
