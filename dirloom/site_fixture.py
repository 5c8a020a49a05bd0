"""A small invented site: list pages, further pages, profiles, missing and moved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources import SiteSpec

ROOT = "https://www.mock.edu"
SPEC = SiteSpec(
    key="mock",
    short_name="MOCK",
    name="Mock University",
    homepage=ROOT,
    domains=["mock.edu"],
    blocked=["old.mock.edu"],
    starts=[f"{ROOT}/"],
    seeds=[f"{ROOT}/department-of-physics/faculty-members", f"{ROOT}/department-of-math/faculty-members", f"{ROOT}/department-of-chemistry/faculty-members"],
    profile=[r"/faculty-view/[\w-]+"],
    departments={"department-of-cse": "Computer Science and Engineering", "department-of-math": "Mathematics", "department-of-chemistry": "Chemistry"},
)


def _page(title: str, body: str) -> str:
    return f'<html><head><title>{title}</title></head><body><nav class="navbar"><a href="/">Home</a></nav><main>{body}</main></body></html>'


def _card(slug: str, name: str, title: str, photo: str = "") -> str:
    return f'<div class="card"><a href="/faculty-view/{slug}"><img src="{photo or f"/uploads/{slug}.jpg"}"></a><h5><a href="/faculty-view/{slug}">{name}</a></h5><p class="designation">{title}</p></div>'


def _profile(name: str, title: str, photo: str, more: str = "") -> str:
    return _page(name, f'<h1>{name}</h1><div class="profile"><img src="{photo}" width="200" height="220"></div><p>{title}</p>{more}')


HOME = _page("Mock University", '<a href="/department-of-cse">Department of CSE</a><a href="/department-of-eee/faculty-members">Faculty Members</a><a href="/news/1">News</a><a href="https://elsewhere.org/faculty">Faculty</a><a href="/admin-staff">Officers</a>')
CSE = _page("Department of CSE", '<a href="/department-of-cse/faculty-members">Our Faculty</a>')
CSE_1 = _page(
    "Faculty Members",
    "<div>" + _card("karlow", "Dr. Anna Karlow", "Professor") + _card("mirstone", "Bela Mirstone", "ASSISTANT PROFESSOR") + _card("dunwick", "Carl Dunwick", "Lecturer", "/img/default-avatar.png") + _card("clerk", "Rolf Kaster", "Office Assistant") + "</div>"
    '<ul class="pagination"><li><a href="?page=2">2</a></ul><a href="/faculty-view/thale-morgen">Thale Morgen</a>',
)
CSE_2 = _page("Faculty Members", "<div>" + _card("elm", "Dora Elmsworth", "Senior Lecturer") + _card("karlow", "Dr. Anna Karlow", "Professor") + _card("ferra", "Ines Ferra", "Lecturer") + "</div>")
EEE = _page("Department of Electrical Engineering | Mock", "<h1>Teachers</h1><table><tr><th>Name</th><th>Title</th></tr><tr><td><a href='/faculty-view/finch'>Edgar Finchley</a><td>Lecturer<tr><td><a href='/faculty-view/gantry'>Flora Gantry</a><td>Professor</table>")
PAGES = [
    # requested, final, html
    ("/", "/", HOME),
    ("/department-of-cse", "/department-of-cse", CSE),
    ("/department-of-cse/faculty-members", "/department-of-cse/faculty-members", CSE_1),
    ("/department-of-cse/faculty-members?page=2", "/department-of-cse/faculty-members?page=2", CSE_2),
    ("/department-of-eee/faculty-members", "/department-of-eee/faculty-members", EEE),
    ("/department-of-math/faculty-members", "/department-of-math/faculty-members", _page("Page not found", "<h1>404</h1>")),
    ("/department-of-chemistry/faculty-members", "/", HOME),
    ("/news/1", "/news/1", _page("News", "<p>x</p>")),
    ("/faculty-view/dunwick", "/faculty-view/dunwick", _profile("Carl Dunwick", "Lecturer", "/uploads/people/dunwick.jpg")),
    ("/faculty-view/finch", "/faculty-view/finch", _profile("Edgar Finchley", "Lecturer", "/uploads/people/finchley.jpg", "<p>Phone: 02-555 1234</p>")),
    ("/faculty-view/gantry", "/", HOME),
    ("/faculty-view/thale-morgen", "/faculty-view/thale-morgen", _profile("Thale Morgen", "Associate Professor", "/uploads/people/thale-morgen.jpg")),
]


def pages(spark: SparkSession) -> DataFrame:
    rows = [(k, ROOT + final, ROOT + asked, html, 200, False) for k, (asked, final, html) in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, requested_url string, html string, status int, rendered boolean")
