"""Clients for tests that note what they are asked in a file."""


def _note(log, what):
    with open(log, "a") as f:
        f.write(what + "\n")


def pages(log):
    def fetch(url):
        _note(log, url)
        if "down" in url:
            raise OSError("down")
        return (b"%PDF" if url.endswith(".pdf") else b"<p>page</p>"), ("application/pdf" if url.endswith(".pdf") else "text/html; charset=utf-8")

    return fetch


def results(log):
    def search(query, k):
        _note(log, query)
        if query == "fail":
            raise OSError("down")
        return [{"href": "https://h/1", "title": query, "body": "b"}, {"href": "javascript:x"}, {"url": "https://h/2"}, {"url": "https://h/3"}]

    return search
