"""Readers of routes, schemas and coverage on sources of many shapes; no session needed."""

from strataq.operators import resolve
from strataq.sources import files, practices, routes, schemas


def found(path, text):
    return [(m, r, line, f) for _, m, r, line, f, *_ in routes.endpoints(path, text)]


def test_script_routes():
    text = """import express from 'express';
const app = express();
// app.get("/commented", f)
app.get("/a", list); const s = "app.get('/in a text')";
users.del('/u/:id', f)
cache.get("/key"); axios.get('/client')
router.route("/both").get(a).post((req, res) => { x.put(1); }).all(b);
app.get(`/t/${x}`, f); app.listen(3)
"""
    assert found("server.js", text) == [("GET", "/a", 4, "Express"), ("DELETE", "/u/:id", 5, "Express"), ("GET", "/both", 7, "Express"), ("POST", "/both", 7, "Express"), ("ANY", "/both", 7, "Express")]
    assert found("client.ts", "import axios from 'axios'\napp.get('/x')") == []
    assert found("plain.js", "app.get('/x', f)\nthing.get('/y', f)") == [("GET", "/x", 1, "Node.js")]


def test_routes_by_folder():
    text = "export async function GET() {}\nexport const POST = f;\nexport function helper() {}\nexport { h as DELETE };"
    assert found("src/app/(shop)/items/[id]/@modal/route.ts", text) == [("GET", "/items/[id]", 1, "Next.js"), ("POST", "/items/[id]", 2, "Next.js"), ("DELETE", "/items/[id]", 4, "Next.js")]
    assert found("pages/api/users/index.ts", "const a = 1\nexport default f") == [("ANY", "/api/users", 2, "Next.js")]
    assert found("pages/api/users/[id].js", "export default f") == [("ANY", "/api/users/[id]", 1, "Next.js")]
    assert found("pages/api/x.ts", "const a = 1") == []


def test_decorated_routes():
    nest = "import { Get } from '@nestjs/common';\n@Controller('cats')\nclass C {\n  @Get()\n  a() {}\n  @Post(':id')\n  @UseGuards(AuthGuard)\n  b(@Body() x) {}\n  @All('z') c() {}\n}"
    assert found("c.ts", nest) == [("GET", "/cats", 4, "NestJS"), ("POST", "/cats/:id", 6, "NestJS"), ("ANY", "/cats/z", 9, "NestJS")]
    java = '@RestController\n@RequestMapping("/api")\npublic class C {\n  @GetMapping("/a") X a() {}\n  @RequestMapping(value = "/b", method = RequestMethod.PUT) X b() {}\n  @DeleteMapping X c() {}\n}'
    assert found("C.java", java) == [("GET", "/api/a", 4, "Spring"), ("PUT", "/api/b", 5, "Spring"), ("DELETE", "/api", 6, "Spring")]
    assert found("D.java", '@GetMapping("/a") class D {}') == []


def test_python_routes():
    flask = "from flask import Flask\n@app.route('/a', methods=['GET', 'post'])\ndef a(): ...\n\n@bp.delete('/b')\n@login_required\ndef b(): ...\n@app.route('relative')\ndef c(): ...\n@cache.memo('/x')\ndef d(): ..."
    assert found("app.py", flask) == [("GET", "/a", 2, "Flask"), ("POST", "/a", 2, "Flask"), ("DELETE", "/b", 5, "Flask")]
    assert found("m.py", "import fastapi\n@r.get(path='/q')\nasync def q(): ...\n@r.api_route('')\ndef e(): ...") == [("GET", "/q", 2, "FastAPI"), ("GET", "/", 4, "FastAPI")]
    django = "urlpatterns = [path('a/', v), re_path(r'^b/$', v), path('c/', include('c.urls'))]\nrouter.register(r'things', T)"
    assert found("site/urls.py", django) == [("ANY", "/a", 1, "Django"), ("ANY", "/b", 1, "Django"), ("ANY", "/things", 2, "Django REST framework")]
    assert found("views.py", django) == [] and found("broken.py", "def (") == []


def test_what_belongs_to_a_route():
    text = "from flask import Flask\n\n@app.get('/a')\ndef a():\n    return request.get_json()\n\n\n\n@login_required\n@app.post('/b')\ndef b(): ...\n"
    (_, _, _, _, _, *a), (_, _, _, _, _, *b) = routes.endpoints("x.py", text)
    assert a == [True, True, False] and b == [True, False, False]  # three lines above a decorator belong to it


def test_sql_schemas():
    sql = """-- CREATE TABLE no (id int);
CREATE TABLE IF NOT EXISTS "public"."Orders" (
  id serial PRIMARY KEY,
  code varchar(20) UNIQUE CHECK (code <> 'a,b'),
  user_id int REFERENCES users(id),
  CONSTRAINT fk FOREIGN KEY (a, "B") REFERENCES t (x, y),
  UNIQUE (a, b)
);
CREATE TEMP TABLE scratch (x int);
CREATE UNIQUE INDEX CONCURRENTLY i ON ONLY orders USING btree (user_id DESC, lower(code));
ALTER TABLE ONLY orders ADD CONSTRAINT k FOREIGN KEY (z) REFERENCES t(id);
"""
    rows = [(o, k, c, line) for _, o, k, c, line in schemas.schema("s.sql", sql)]
    assert rows == [
        ("orders", "table", [], 2), ("orders", "primary", ["id"], 3), ("orders", "index", ["code"], 4), ("orders", "foreign", ["user_id"], 5), ("orders", "foreign", ["a", "b"], 6),
        ("orders", "index", ["a", "b"], 7), ("scratch", "temporary", [], 9), ("orders", "index", ["user_id", "lower"], 10), ("orders", "foreign", ["z"], 11),
    ]
    mysql = "CREATE TABLE a (id INT AUTO_INCREMENT, b INT, KEY k (b), FOREIGN KEY (c) REFERENCES t(id)) ENGINE=InnoDB"
    assert [(k, c) for _, _, k, c, _ in schemas.schema("m.sql", mysql)] == [("table", []), ("index", ["b"]), ("foreign", ["c"]), ("index", ["c"])]


def test_prisma_schemas():
    text = 'datasource db {\n  provider = "%s"\n}\nmodel Post {\n  id Int @id // key\n  slug String @unique\n  authorId Int\n  author User @relation("x", fields: [authorId, other], references: [id])\n  tags Tag[]\n  @@index([slug(sort: Desc), authorId])\n  @@unique(fields: [a, b])\n  @@map("posts")\n}\nenum E {\n  A\n}'
    want = [("table", [], 4), ("primary", ["id"], 5), ("index", ["slug"], 6), ("foreign", ["authorid", "other"], 8), ("index", ["slug", "authorid"], 10), ("index", ["a", "b"], 11)]
    rows = lambda provider: [(k, c, line) for _, o, k, c, line in schemas.schema("s.prisma", text % provider) if o == "post"]
    assert rows("postgresql") == want
    assert rows("mysql") == sorted([*want, ("index", ["authorid", "other"], 8)], key=lambda r: r[2])


def test_coverage_reports():
    assert practices.coverage("a/cov.xml", '<?xml version="1.0"?><!DOCTYPE coverage><coverage line-rate="0.5"><packages/></coverage>') == [("a/cov.xml", "Cobertura", 50.0)]
    assert practices.coverage("x.xml", "<report/>") == [] and practices.coverage("x.json", "[1]") == [] and practices.coverage("lcov.info", "") == []


def test_names_that_are_never_read_and_modules_that_come_along():
    assert {"env", "Pods", "__MACOSX", ".svelte-kit"} <= set(files.IGNORED) and len(files.IGNORED) == 28
    assert {"async_hooks", "diagnostics_channel", "trace_events"} <= set(resolve.NODE_BUILTINS)
    assert {"shlex", "tarfile", "tokenize", "bz2", "lzma", "keyword", "contextvars", "__future__"} <= set(resolve.PYTHON_STANDARD)
