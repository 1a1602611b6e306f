"""One-at-a-time processing of change requests in plain Python, to check the bulk jobs."""

import json
import unicodedata

from rowsmith.schemas import PARENT_OF, TABLES


def fold_text(s):
    flat = unicodedata.normalize("NFD", s.casefold())
    return "".join(c for c in flat if not unicodedata.combining(c))


class Store:
    def __init__(self, rows, now):
        self.now = now
        self.rows = {
            n: {r[0]: dict(zip(t.schema.fieldNames(), r)) for r in rows[n]}
            for n, t in TABLES.items()
        }
        self.next = {n: max(self.rows[n], default=0) + 1 for n in TABLES}

    def _taken(self, spec, row, but=None):
        if spec.unique is None:
            return False

        def key(r):
            return tuple(fold_text(r[c]) if c in spec.unique.text else r[c] for c in spec.unique.columns)

        return any(k != but and key(r) == key(row) for k, r in self.rows[spec.name].items())

    def create(self, name, body):
        spec = TABLES[name]
        row = {f.name: body.get(f.name) for f in spec.schema.fields}
        if any(row[c] is None for c in spec.create if c in spec.required):
            return 422, None
        for c, low, high in spec.ranges:
            if row[c] is not None and not low <= row[c] <= high:
                return 422, None
        for c in spec.references:
            if row[c] not in self.rows[PARENT_OF[c]]:
                return 400, None
        if any(row[c] is not None and len(row[c]) > n for c, n in spec.lengths.items()):
            return 500, None
        if self._taken(spec, row):
            return 409, None
        for c in spec.stamps:
            row[c] = self.now
        row[spec.key] = self.next[name]
        self.next[name] += 1
        self.rows[name][row[spec.key]] = row
        return 200, row[spec.key]

    def patch(self, name, target, body, sub=None):
        spec = TABLES[name]
        try:
            doc = json.loads(body)
        except ValueError:
            return 422
        if spec.owned:
            try:
                actor = int(sub)
            except (TypeError, ValueError):
                return 401
            if actor not in self.rows[name]:
                return 401
        if not isinstance(doc, dict):
            return 422
        doc = {k: v for k, v in doc.items() if k in spec.patch}
        for c, v in doc.items():
            kind = int if spec.schema[c].dataType.typeName() == "integer" else str
            if v is not None and not isinstance(v, kind):
                return 422
        for c, low, high in spec.ranges:
            if doc.get(c) is not None and not low <= doc[c] <= high:
                return 422
        if spec.owned and actor != target:
            return 403
        row = self.rows[name].get(target)
        if row is None:
            return 404
        if not doc:
            return 200
        for c in spec.references:
            if doc.get(c) is not None and doc[c] not in self.rows[PARENT_OF[c]]:
                return 400
        new = {**row, **doc}
        for f in spec.schema.fields:
            if f.name in doc and new[f.name] is None and not f.nullable:
                return spec.null_code
            if f.name in doc and f.name in spec.lengths and new[f.name] is not None:
                if len(new[f.name]) > spec.lengths[f.name]:
                    return 500
        if spec.unique and set(spec.unique.columns) & set(doc) and self._taken(spec, new, target):
            return 409
        if spec.touch and new != row:
            new[spec.touch] = self.now
        self.rows[name][target] = new
        return 200

    def delete(self, name, target):
        return 200 if self.rows[name].pop(target, None) is not None else 404

    def listed(self, name):
        fields = TABLES[name].schema.fieldNames()
        return [tuple(r[f] for f in fields) for _, r in sorted(self.rows[name].items())]
