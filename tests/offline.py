"""Answers of a people search and of two sites, served from memory to the readers of the live sources."""

import json

PEOPLE = [{"id": str(i), "name": f"Person {i}", "organization": {"domain": f"c{i % 3}.example"}} for i in range(23)]
PAGES = {
    "https://one.example": "<title>One Ltd</title><a href='/contact'>c</a>",
    "https://one.example/contact": "<a href='mailto:hi@one.example'>m</a><a href='/about'>a</a>",
    "https://one.example/about": "<meta name='description' content='never read: two pages a site'>",
    "https://closed.example": "<title>Closed</title>",
    "https://closed.example/robots.txt": "User-agent: *\nDisallow: /",
}
state = {"fails": 0}


def people(method, url, headers, body, timeout):
    if headers.get("X-Api-Key") != "key-123456":
        return 401, {}, b""
    ask = json.loads(body)
    if ask["page"] == 2 and not state["fails"]:
        state["fails"] = 1
        return 429, {"Retry-After": "0"}, b""
    a = (ask["page"] - 1) * ask["per_page"]
    return 200, {}, json.dumps({"people": [*PEOPLE[a : a + ask["per_page"]]]}).encode()


def site(method, url, headers, body, timeout):
    return (200, {}, PAGES[url].encode()) if url in PAGES else (404, {}, b"no")
