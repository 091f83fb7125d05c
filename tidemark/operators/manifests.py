"""Symbols of YAML manifests, of library definitions, of templates and of whole files.

Parsers are small functions that tasks call for each file (see ``extract.symbols``); what needs
other files, as a component's siblings or the extension that a file belongs to, is a join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists of scalars whose order means nothing, by their path in a manifest.
UNORDERED = ("dependencies", "test_dependencies", "libraries", "install", "recipes", "appears_on", "permissions", "dependencies.module", "dependencies.theme", "dependencies.config")


def load(text: str):
    """The data of a YAML text and, for each entry of its top level (and of ``services``), where it stands.

    Words such as yes and on are strings, a tagged value is a map of its tag and value. None, and
    no places, where the text can't be parsed.
    """
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    dropped = ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")
    Loader.yaml_implicit_resolvers = {c: [x for x in rules if x[0] not in dropped] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def tagged(loader, suffix, node):
        kind = {"scalar": loader.construct_scalar, "sequence": lambda n: loader.construct_sequence(n, deep=True), "mapping": lambda n: loader.construct_mapping(n, deep=True)}[node.id]
        return {"tag": suffix, "value": kind(node)}

    Loader.add_multi_constructor("!", tagged)
    loader = Loader(text)
    try:
        node = loader.get_single_node()
        data = loader.construct_document(node) if node is not None else None
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None, {}
    finally:
        loader.dispose()
    places: dict[str, tuple[int, int]] = {}
    for root in [node] if isinstance(node, yaml.MappingNode) else []:
        for key, value in root.value:
            places[key.value] = (key.start_mark.index, value.end_mark.index)
            if key.value == "services" and isinstance(value, yaml.MappingNode):
                places |= {f"services.{k.value}": (k.start_mark.index, v.end_mark.index) for k, v in value.value}
    return data, places


def canonical(value, path: str = ""):
    """Strings trimmed, maps by key, and the lists that ``UNORDERED`` names, or that extend libraries, sorted."""
    if isinstance(value, dict):
        return {str(k): canonical(v, f"{path}.{k}".lstrip(".")) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
    if isinstance(value, list):
        items = [canonical(v, path) for v in value]
        free = path in UNORDERED or path.startswith("libraries-extend.")
        return sorted(items, key=str) if free and not any(isinstance(v, dict | list) for v in items) else items
    return value.strip() if isinstance(value, str) else value


def as_json(value) -> str:
    return json.dumps(value, sort_keys=False, default=str, ensure_ascii=False)


def text_of(value) -> str | None:
    """A scalar's trimmed text, None if it is empty or no scalar."""
    if isinstance(value, dict | list) or value is None:
        return None
    out = ("1" if value else "") if isinstance(value, bool) else str(value).strip()
    return out or None


def strings(value) -> list[str]:
    """The texts of a list's or map's scalars, each once and sorted."""
    items = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return sorted({t for t in map(text_of, items) if t})


def targets(dependencies: list[str]) -> list[str]:
    """What dependencies name, without the project before a colon and what follows in parentheses."""
    names = (re.sub(r"\s*\(.*$", "", d.strip(), flags=re.S) for d in dependencies)
    return sorted({n for n in (x.split(":", 1)[-1].strip() for x in names) if n})


def owners(value) -> list[str]:
    """The owners of all libraries that keys and texts of a nested value name."""
    found: set[str] = set()
    waiting = [value]
    while waiting:
        now = waiting.pop()
        pairs = now.items() if isinstance(now, dict) else enumerate(now) if isinstance(now, list) else ()
        for k, v in pairs:
            found |= {x.split("/")[0] for x in (k, v) if isinstance(x, str) and "/" in x}
            waiting += [v] if isinstance(v, dict | list) else []
    return sorted(found - {""})


def _symbol(kind: str, name: str, signature, metadata: dict, place: tuple[int, int], **more) -> dict:
    return {"symbol_type": kind, "fqn": name, "name": name, "signature_json": as_json(signature), "metadata_json": as_json(metadata), "start": place[0], "end": place[1]} | more


def _info(path: str, data: dict, whole: tuple[int, int]) -> dict:
    declared = str(data.get("type") or "module").lower()
    kind = f"{declared}_info" if declared in ("theme", "profile", "theme_engine") else "module_info"
    needs = strings(data.get("dependencies"))
    base = text_of(data.get("base theme"))
    mentioned = {*targets(needs), *([base] if base else []), *(o for k in ("libraries", "libraries-extend", "libraries-override") for o in owners(data.get(k)))}
    metadata = {
        "file_kind": kind, "label": text_of(data.get("name")), "declared_type": declared, "dependencies": needs, "dependency_targets": targets(needs),
        "configure_route": text_of(data.get("configure")), "base_theme": base, "mentioned_extensions": sorted(mentioned),
    }
    return _symbol(kind, path.rsplit("/", 1)[-1].removesuffix(".info.yml"), canonical(data), metadata, whole)


def _links(kind: str, data: dict, places: dict) -> Iterator[dict]:
    for name, entry in data.items():
        if not isinstance(name, str):
            continue
        e = entry if isinstance(entry, dict) else {}
        told = {k: text_of(e.get(k)) for k in ("title", "description", "route_name", "base_route", "parent", "parent_id", "group")}
        on = strings(e.get("appears_on"))
        metadata = {"file_kind": kind} | told | {"appears_on": on, "route_refs": sorted({x for x in (told["route_name"], told["base_route"], *on) if x})}
        yield _symbol(kind, name, canonical(entry if isinstance(entry, dict) else {"value": entry}), metadata, places[name])


def _services(data: dict, places: dict) -> Iterator[dict]:
    entries = data.get("services")
    for name, entry in (entries if isinstance(entries, dict) else {}).items():
        if name in ("_defaults", "parameters") or not isinstance(entry, dict):
            continue
        told = {k: canonical(entry.get(k)) for k in ("class", "arguments", "tags")}
        place = places[f"services.{name}"]
        yield _symbol("service", str(name), canonical(entry), told, place)
        if "event_subscriber" in as_json(told["tags"]):
            metadata = {"service_id": str(name), "class": told["class"] or str(name), "source": "services"}
            yield _symbol("event_subscriber", str(name), metadata, metadata, place)


def _routes(data: dict, places: dict) -> Iterator[dict]:
    for name, entry in data.items():
        if not isinstance(entry, dict):
            continue
        defaults = entry.get("defaults") if isinstance(entry.get("defaults"), dict) else {}
        controller = next((v for k, v in defaults.items() if isinstance(v, str) and "::" in v), None)
        told = {k: canonical(entry.get(k)) for k in ("path", "defaults", "requirements", "options", "methods")} | {"controller": controller}
        signature = canonical(entry) | ({"controller": controller} if controller else {})
        yield _symbol("route", str(name), signature, told, places[str(name)])


def _permissions(data: dict, places: dict) -> Iterator[dict]:
    for name, entry in data.items():
        if isinstance(entry, dict):
            told = {"title": text_of(entry.get("title")) or text_of(entry.get("label")), "description": text_of(entry.get("description")), "restrict_access": entry.get("restrict access") is True}
            yield _symbol("permission", str(name), canonical(entry), told, places[str(name)])


def _config(path: str, data: dict, whole: tuple[int, int]) -> dict:
    kept = {k: v for k, v in data.items() if k not in ("uuid", "langcode")}
    if isinstance(kept.get("_core"), dict):
        kept["_core"] = {k: v for k, v in kept["_core"].items() if k != "default_config_hash"}
        kept = kept if kept["_core"] else {k: v for k, v in kept.items() if k != "_core"}
    shape = canonical(kept)
    needs = shape.get("dependencies") if isinstance(shape.get("dependencies"), dict) else {}
    metadata = {"file_kind": "config_export", "top_level_keys": list(shape), "dependency_modules": strings(needs.get("module")), "dependency_themes": strings(needs.get("theme")), "dependency_config": strings(needs.get("config"))}
    return _symbol("config_export", re.sub(r"\.ya?ml$", "", path.rsplit("/", 1)[-1]), shape, metadata, whole)


def _recipe(path: str, data: dict, whole: tuple[int, int]) -> dict:
    folder = path.rsplit("/", 2)[-2] if "/" in path else ""
    slug = re.sub("[^a-z0-9]+", "_", (text_of(data.get("name")) or "recipe").lower()).strip("_") or "recipe"
    install = strings(data.get("install"))
    metadata = {"file_kind": "recipe_manifest", "label": text_of(data.get("name")), "recipe_type": text_of(data.get("type")), "install": install, "recipes": strings(data.get("recipes")), "mentioned_extensions": install}
    return _symbol("recipe_manifest", folder if folder not in ("", ".") else slug, canonical(data), metadata, whole)


def _component(path: str, data: dict, whole: tuple[int, int]) -> dict:
    keys = lambda k: [str(x) for x in data[k]] if isinstance(data.get(k), dict) else []
    status = data.get("status", "stable")
    metadata = {"file_kind": "component", "label": text_of(data.get("name")), "description": text_of(data.get("description")), "status": text_of(status), "props": keys("props"), "slots": keys("slots"), "library": canonical(data.get("library"))}
    return _symbol("component", path.rsplit("/", 1)[-1].removesuffix(".component.yml"), canonical(data), metadata, whole)


# Fixed value: the folders of exported configuration.
EXPORTS = ("db/config", "config/sync")


def yaml_symbols(path: str, text: str) -> Iterator[dict]:
    """Manifests, link entries, recipes, components, exported configuration, services, routes, permissions and schemas.

    The name of the file, and for exported configuration its folder, tells what it holds.
    """
    data, places = load(text)
    data, name, whole = data if isinstance(data, dict) else {}, path.rsplit("/", 1)[-1], (0, len(text))
    links = re.search(r"\.links\.(menu|task|action|contextual)\.yml$", name)
    if name.endswith(".info.yml"):
        yield _info(path, data, whole)
    elif links:
        yield from _links(f"link_{links[1]}", data, places)
    elif name == "recipe.yml":
        yield _recipe(path, data, whole)
    elif name.endswith(".component.yml"):
        yield _component(path, data, whole)
    elif name.endswith((".yml", ".yaml")) and f"/{path.rpartition('/')[0]}".endswith(tuple(f"/{x}" for x in EXPORTS)):
        yield _config(path, data, whole)
    elif name.endswith("services.yml"):
        yield from _services(data, places)
    elif name.endswith(".routing.yml"):
        yield from _routes(data, places)
    elif name.endswith(".permissions.yml"):
        yield from _permissions(data, places)
    elif name.endswith(".schema.yml"):
        for key in data:
            yield {"symbol_type": "config_schema", "fqn": str(key), "name": str(key), "start": places[str(key)][0], "end": places[str(key)][0] + len(str(key))}


_OUTSIDE = re.compile(r"//|[a-z][a-z0-9+.-]*:", re.I)


def _assets(node, ending: str, group: str | None = None) -> Iterator[tuple[str, str | None]]:
    """(path, group) of a nested map's keys that are paths of a kind, or addresses."""
    for key, value in node.items() if isinstance(node, dict) else ():
        if not isinstance(key, str) or not key:
            continue
        if key.lower().endswith((ending, f"{ending}.map")) or _OUTSIDE.match(key):
            yield key.strip(), group
        elif isinstance(value, dict):
            yield from _assets(value, ending, key)


def resolved_path(file_path: str, asset: str) -> str | None:
    """An asset's path below the root of the tree; None for an address elsewhere."""
    if _OUTSIDE.match(asset):
        return None
    whole = asset if asset.startswith("/") else f"{file_path.rpartition('/')[0]}/{asset}"
    parts: list[str] = []
    for part in whole.replace("\\", "/").split("/"):
        if part == "..":
            parts[-1:] = []
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def library_symbols(path: str, text: str) -> Iterator[dict]:
    """Libraries with their assets, dependencies, version, license and what deprecates them."""
    data, places = load(text)
    owner = path.rsplit("/", 1)[-1].removesuffix(".libraries.yml")
    for key, value in (data if isinstance(data, dict) else {}).items():
        if not isinstance(key, str) or not key:
            continue
        value = value if isinstance(value, dict) else {"value": value}
        listed = {kind: [(a, g, resolved_path(path, a)) for a, g in _assets(value.get(part), f".{part}")] for kind, part in (("javascript", "js"), ("css", "css"))}
        every = [x for found in listed.values() for x in found]
        of = lambda kind: sorted({r or a for a, _, r in listed[kind]})  # noqa: B023, E731
        needs = strings(value.get("dependencies"))
        license_ = value.get("license")
        metadata = {
            "file_kind": "library", "owner": owner, "asset_paths": sorted({r for _, _, r in every if r}), "javascript_assets": of("javascript"), "css_assets": of("css"),
            "external_assets": sorted({a for a, _, r in every if r is None}), "dependency_libraries": needs, "dependency_owners": owners(needs), "remote": text_of(value.get("remote")),
            "version": text_of(value.get("version")), "license": text_of(license_.get("name")) if isinstance(license_, dict) else text_of(license_),
        }
        moved = value.get("moved_files")
        message = text_of(value.get("deprecated")) or (f"Library moved or has moved files: {as_json(canonical(moved))}" if isinstance(moved, dict | list) and moved else None)
        gone = {}
        if message:
            version = lambda verb: re.search(rf"{verb} in \w+[: ](\d+\.\d+\.\d+)|{verb} from \w+[: ](\d+\.\d+\.\d+)", message)  # noqa: B023, E731
            since, until = version("deprecated"), version("removed")
            gone = {"is_deprecated": 1, "deprecation_message": message, "deprecation_version": since and (since[1] or since[2]), "removal_version": until and (until[1] or until[2])}
        yield _symbol("library", key, canonical(value), metadata, places[key], **gone) | {"fqn": f"{owner}/{key}"}


_PART = re.compile(r"\{#.*?#\}|(?P<tag>\{%-?\s*(?P<verb>\w+)(?P<rest>(?>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?)-?%\})|(?P<out>\{\{(?P<what>(?>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|[^'\"])*?)\}\})", re.S)
_WORD = re.compile(r"(?P<string>'(?>\\.|[^'\\])*+'|\"(?>\\.|[^\"\\])*+\")|\|\s*(?P<filter>[^\W\d]\w*)|(?P<call>[^\W\d]\w*)\s*\(|(?P<variable>[^\W\d]\w*)", re.S)
#: Words of expressions that are no variables.
_EXPRESSION = frozenset("and or not in is with only as if else from import true false null none matches starts ends same divisible by defined empty iterable even odd constant b-and b-or b-xor".split())
_TAGS = ("include", "embed", "extends", "component", "block", "set", "for", "if")
_COMPONENT_TAGS = {"twig_include": "sdc_include", "twig_embed": "sdc_embed", "twig_component": "sdc_call"}


def twig_symbols(path: str, text: str) -> Iterator[dict]:
    """Tags, outputs, function calls and filters of a template; tags and calls that name a component as such.

    A tag is named by its last string, else by its first variable; an output by its first
    variable; both are anonymous without. Comments have no symbols.
    """
    for part in _PART.finditer(text):
        body = part["rest"] if part["tag"] else part["what"]
        if body is None:
            continue
        at = part.start("rest") if part["tag"] else part.start("what")
        words = list(_WORD.finditer(body))
        variables = [m["variable"] for m in words if m["variable"] and m["variable"] not in _EXPRESSION]
        texts = [m["string"][1:-1].strip() for m in words if m["string"]]
        place = {"start": part.start(), "end": part.end()}
        if part["tag"]:
            if part["verb"].startswith("end"):
                kind, name = "twig_tag", "anonymous"
            else:
                kind = f"twig_{part['verb']}" if part["verb"] in _TAGS else "twig_tag"
                name = texts[-1] if texts else variables[0] if variables else "anonymous"
                kind = _COMPONENT_TAGS.get(kind, kind) if ":" in name else kind
        else:
            kind, name = "twig_variable", variables[0] if variables else "anonymous"
        yield {"symbol_type": kind, "fqn": name, "name": name} | place
        for k, m in enumerate(words):
            place = {"start": at + m.start(), "end": at + m.end()}
            if m["filter"]:
                yield {"symbol_type": "twig_filter", "fqn": m["filter"], "name": m["filter"]} | place
            elif m["call"] and m["call"] not in _EXPRESSION:
                told = next((x["string"][1:-1].strip() for x in words[k + 1 :] if x["string"]), "") if m["call"] == "component" else ""
                yield {"symbol_type": "sdc_function" if told else "twig_function", "fqn": told or m["call"], "name": told or m["call"]} | place


# What needs more than one file.


def whole_files(files: DataFrame) -> DataFrame:
    """One symbol for each file, for kinds that nothing is extracted from: its name, its ending's type and its hash."""
    name = F.element_at(F.split("file_path", "/"), -1)
    ending = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return files.where("text is not null").select(
        "file_path", ending.alias("language"), F.concat(ending, F.lit("_file")).alias("symbol_type"), name.alias("fqn"), name.alias("name"),
        F.lit(1).alias("line_start"), lines.cast("int").alias("line_end"), F.lit('{"type":"file"}').alias("signature_json"), F.sha2("text", 256).alias("signature_hash"),
    )


def component_files(files: DataFrame) -> DataFrame:
    """(file_path, component, has_twig, has_css, has_js) of each component's manifest among all files, by its siblings' names."""
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("")
    named = files.select("file_path", folder.alias("folder"), F.element_at(F.split("file_path", "/"), -1).alias("name"))
    manifests = named.where(F.col("name").endswith(".component.yml")).select("file_path", "folder", F.regexp_replace("name", r"\.component\.yml$", "").alias("component"))
    ending = F.substring_index("name", ".", -1)
    siblings = named.where(ending.isin("twig", "css", "js")).select("folder", F.regexp_replace("name", r"\.(twig|css|js)$", "").alias("component"), ending.alias("ending"))
    has = [F.coalesce(F.max(F.col("ending") == e), F.lit(False)).alias(f"has_{e}") for e in ("twig", "css", "js")]
    return manifests.join(siblings, ["folder", "component"], "left").groupBy("file_path", "component").agg(*has)


def component_context(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """(file_path, sdc_component) of all files in a component's folder: the owning extension and the component, by a colon.

    ``extensions`` has folder and owner; the deepest folder above counts, and a component without
    an extension above has no name. Of several components in a folder the first by name.
    """
    from tidemark.operators.relations import owner_of

    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("")
    inside = files.select("file_path", folder.alias("of"))
    manifests = inside.where(F.col("file_path").endswith(".component.yml"))
    owned = owner_of(manifests.select("file_path"), extensions)
    component = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.component\.yml$", "")
    named = manifests.join(owned, "file_path").groupBy("of").agg(F.min(F.concat("owner", F.lit(":"), component)).alias("sdc_component"))
    return inside.join(named, "of").select("file_path", "sdc_component")
