"""Pages for tests, made apart from the layouts that the classifier is learned from: names in four languages, no names, and names that mislead."""

import random

#: Names of what is no content, as sites in four languages write them.
NAMES = {
    "menu": "hauptmenue navigationsleiste menu-principal navigation-principale menu-principal-es navegacion top-nav navbar".split(),
    "side": "seitenleiste randspalte barre-laterale colonne-laterale barra-lateral columna-lateral sidebar side-rail".split(),
    "foot": "fusszeile seitenfuss pied-de-page bas-de-page pie-de-pagina pie footer site-footer".split(),
    "ad": "werbung anzeige publicite annonce publicidad anuncio ad advert".split(),
    "talk": "kommentare leserkommentare commentaires avis-des-lecteurs comentarios opiniones comments discussion".split(),
    "note": "hinweis cookie-hinweis avertissement bandeau-cookies aviso aviso-de-cookies cookie-notice consent".split(),
}
BODY = "artikel beitrag inhalt contenu corps-article billet contenido cuerpo entrada content post story".split()
#: Names that an article may have although they are those of something else.
MISLEADING = "social menu legal related tag-social promo search notice-board sponsored-by widget".split()
WORDS = "der die und ist nicht the of and that with le la les des dans el los que para con montag wasser stone river maison camino".split()


class Maker:
    def __init__(self, seed):
        self.r, self.said, self.style = random.Random(seed), [], random.Random(seed * 7 + 1).choice(("named", "named", "nameless", "random"))

    def prose(self, a, b):
        text = " ".join(self.r.choices(WORDS, k=self.r.randint(a, b))).capitalize()
        return f"{text} {len(self.said)} {self.r.randint(100, 10**6)}."

    def say(self, text, content, form="<p>@</p>"):
        self.said.append((" ".join(text.split()), content))
        return form.replace("@", text)

    def named(self, kind, inner, tags=("div",)):
        tag = self.r.choice(tags)
        name = self.r.choice(NAMES[kind]) if self.style == "named" else "".join(self.r.choices("abcxyzq", k=5)) if self.style == "random" else ""
        mark = f' {self.r.choice(("class", "id"))}="{name}"' if name else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def links(self, n):
        return "<ul>" + "".join(self.say(f"{self.r.choice(WORDS)} {len(self.said)}", False, '<li><a href="/x">@</a></li>') for _ in range(n)) + "</ul>"

    def page(self):
        r = self.r
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        name = r.choice(MISLEADING) if tag == "article" and r.random() < 0.4 else r.choice(BODY) if self.style == "named" and r.random() < 0.7 else ""
        inner = [self.say(self.prose(3, 7), True, "<h1>@</h1>")] + [self.paragraph() for _ in range(r.randint(2, 9))]
        if r.random() < 0.3:
            inner.insert(r.randint(1, len(inner)), self.named("ad", self.say(self.prose(3, 8), False)) if self.style == "named" else "")
        body = f"<{tag}" + (f' class="{name}"' if name else "") + ">" + "".join(inner) + f"</{tag}>"
        before = [self.named("menu", self.links(r.randint(3, 8)), ("div", "nav"))] if r.random() < 0.8 else []
        if r.random() < 0.3 and self.style == "named":
            before.append(self.named("note", self.say(self.prose(5, 15), False)))
        after = []
        if r.random() < 0.4 and (self.style == "named" or tag in ("article", "main")):
            after.append(self.named("talk", "".join(self.say(self.prose(4, 25), False, r.choice(("<p>@</p>", "<div><p>@</p></div>"))) for _ in range(r.randint(1, 4)))))
        if r.random() < 0.5:
            after.append(self.named("side", self.say(f"{r.choice(WORDS)} {len(self.said)} {r.choice(WORDS)}", False, "<h3>@</h3>") + self.links(r.randint(2, 6)), ("div", "aside")))
        if r.random() < 0.7:
            after.append(self.named("foot", self.say(f"© 2024 {r.choice(WORDS)} {len(self.said)} · {r.choice(WORDS)} | {r.choice(WORDS)}", False), ("div", "footer")))
        wrap = r.choice(("@", "<div>@</div>", '<div class="wrapper"><div>@</div></div>'))
        return f"<html><head><title>t</title></head><body>{wrap.replace('@', ''.join([*before, body, *after]))}</body></html>", dict(self.said)

    def paragraph(self):
        r = self.r
        k = r.random()
        if k < 0.1:  # mostly links
            return self.say(self.prose(6, 12), True, '<p>See <a href="/y">@</a></p>').replace("See ", "")
        if k < 0.2:
            return self.say(self.prose(2, 4), True, r.choice(("<h2>@</h2>", "<p>@</p>", "<li>@</li>")))
        if k < 0.27:
            return f'<div class="{r.choice(MISLEADING)}">' + self.say(self.prose(10, 40), True) + "</div>"
        return self.say(self.prose(8, 60), True)


def pages(first, number):
    return [Maker(k).page() for k in range(first, first + number)]
