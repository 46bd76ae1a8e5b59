"""Markup analysis: elements and attributes with places, bindings, resources, names, and the rules over them."""

from __future__ import annotations

from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

# The patterns of markup extensions, and corrections of common attribute typos.
STATIC_RESOURCE = r"\{StaticResource\s+([^}]+)\}"
DYNAMIC_RESOURCE = r"\{DynamicResource\s+([^}]+)\}"
MODES = ("OneWay", "TwoWay", "OneTime", "OneWayToSource", "Default")
TYPOS = {
    "Visibilty": "Visibility", "Visibile": "Visibility", "IsEnabeld": "IsEnabled", "IsEnabel": "IsEnabled", "Backgroud": "Background", "Foregroud": "Foreground",
    "Conent": "Content", "Heigth": "Height", "Widht": "Width", "Maring": "Margin", "Pading": "Padding", "ItemSouce": "ItemsSource", "ItemSource": "ItemsSource",
    "SelectedItme": "SelectedItem", "Commnad": "Command", "CommandParamter": "CommandParameter", "DataContex": "DataContext", "TextWraping": "TextWrapping",
    "Strech": "Stretch", "Orientaiton": "Orientation", "Horiontal": "Horizontal", "Verticla": "Vertical", "MaxHeigth": "MaxHeight", "MinHeigth": "MinHeight",
    "MaxWidht": "MaxWidth", "MinWidht": "MinWidth", "FontSzie": "FontSize", "FontWieght": "FontWeight", "ToolTop": "ToolTip",
}
CLR_NAMESPACES = {"http://schemas.microsoft.com/winfx/2006/xaml/presentation": "System.Windows.Controls", "http://schemas.microsoft.com/winfx/2006/xaml": "System.Windows.Markup"}


def _braces(depth: int) -> str:
    """A pattern of balanced braces, down to so many within each other."""
    return r"\{[^{}]*\}" if depth <= 1 else r"\{(?:[^{}]|" + _braces(depth - 1) + r")*\}"


NESTED = _braces(4)
BINDING = r"\{(?:Binding|x:Bind)\b\s*((?:[^{}]|" + NESTED + r")*)\}"
ELEMENTS = "path string, id int, parent_id int, depth int, name string, line int, col int, attributes array<struct<name:string,value:string>>, error string"


def parse(path: str, content: str) -> list[tuple]:
    """Elements in order with their places; a malformed text gives what came before and a row with the error."""
    rows, stack = [], []
    parser = expat.ParserCreate()
    parser.ordered_attributes = True

    def start(name, attributes):
        rows.append((path, len(rows), stack[-1] if stack else None, len(stack), name, parser.CurrentLineNumber, parser.CurrentColumnNumber + 1, list(zip(attributes[::2], attributes[1::2])), None))
        stack.append(len(rows) - 1)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: stack.pop()
    try:
        parser.Parse(content or "", True)
    except expat.ExpatError as e:
        rows.append((path, len(rows), None, 0, "", e.lineno, e.offset + 1, [], expat.ErrorString(e.code)))
    return rows


def elements(files: DataFrame) -> DataFrame:
    """One row per element of each file (path, content); each task parses the files of its partition."""
    import pandas as pd

    columns = [c.split()[0] for c in ELEMENTS.split(", ")]

    def apply(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in parse(p, c)]
            out = pd.DataFrame(rows, columns=columns)
            out["parent_id"] = out["parent_id"].astype("Int32")
            out["attributes"] = [[{"name": n, "value": v} for n, v in own] for own in out["attributes"]]
            yield out

    return files.select("path", "content").mapInPandas(apply, ELEMENTS)


def attributes(rows: DataFrame) -> DataFrame:
    """Per attribute its element, value, and for attached ones (Owner.Property) both parts."""
    own = rows.select("path", F.col("id").alias("element_id"), F.col("name").alias("element"), "line", "col", F.explode("attributes").alias("a")).select("path", "element_id", "element", "line", "col", "a.name", "a.value")
    attached = F.col("name").contains(".") & ~F.col("name").startswith("xmlns")
    return own.withColumns({"is_attached": attached, "owner_type": F.when(attached, F.split("name", r"\.", 2)[0]), "property_name": F.when(attached, F.split("name", r"\.", 2)[1])})


def _flat(content: Column) -> Column:
    """The content with nested extensions emptied, so that their parts aren't taken for its own."""
    return F.regexp_replace(content, NESTED, "{}")


def _part(content: Column, name: str) -> Column:
    """The value of a named part, or null."""
    out = F.trim(F.regexp_extract(_flat(content), rf"(?:^|,)\s*{name}\s*=\s*([^,]+)", 1))
    return F.when(out != "", out)


def converter(content: Column) -> Column:
    """The converter's resource key, or its text where it is no resource; null without one."""
    text = F.trim(F.regexp_extract(content, rf"(?:^|,)\s*Converter\s*=\s*({NESTED}|[^,{{}}]+)", 1))
    key = F.trim(F.regexp_extract(text, r"^\{(?:StaticResource|DynamicResource)\s+(?:ResourceKey\s*=\s*)?([^}]+)\}$", 1))
    return F.when(key != "", key).when(text != "", text)


def binding_path(content: Column) -> Column:
    """The named path, or the first part where that is none of the named ones; null without a path."""
    first = F.regexp_extract(_flat(content), r"^\s*([A-Za-z_\[(][^,={}]*?)\s*(?:,|$)", 1)
    return F.coalesce(_part(content, "Path"), F.when(first != "", first))


def bindings(texts: DataFrame, text: str = "value") -> DataFrame:
    """Each binding in a text column with its parts; the text's other columns stay. Bindings within others are their parts."""
    rest = [c for c in texts.columns if c != text]
    own = texts.select(*rest, F.posexplode(F.regexp_extract_all(text, F.lit(BINDING), 1)).alias("seq", "content"))
    c = F.col("content")
    return own.select(*rest, "seq", binding_path(c).alias("binding_path"), _part(c, "Mode").alias("mode"), converter(c).alias("converter"), _part(c, "ElementName").alias("element_name"))


def resource_references(texts: DataFrame, text: str = "value") -> DataFrame:
    rest = [c for c in texts.columns if c != text]
    parts = [texts.select(*rest, F.explode(F.regexp_extract_all(text, F.lit(p), 1)).alias("key")).withColumn("is_static", F.lit(s)) for p, s in ((STATIC_RESOURCE, True), (DYNAMIC_RESOURCE, False))]
    return parts[0].unionByName(parts[1]).withColumn("key", F.trim("key"))


def resources(attrs: DataFrame) -> DataFrame:
    return attrs.where("name = 'x:Key'").select("path", F.col("value").alias("key"), F.col("element").alias("type"), "line", "col")


def named_elements(attrs: DataFrame) -> DataFrame:
    return attrs.where(F.col("name").isin("x:Name", "Name")).select("path", F.col("value").alias("name"), F.col("element").alias("type"), "line", "col")


def duplicate_names(named: DataFrame) -> DataFrame:
    """Names that occur more than once in a file, with their lines in order."""
    return named.groupBy("path", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines")).where("n > 1")


def repeated_after_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """All rows of a key but the first in order."""
    from pyspark.sql import Window as W

    from .graph import free_name

    n = free_name(rows, "_n")
    return rows.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(n) > 1).drop(n)


def unused_resources(defined: DataFrame, used: DataFrame) -> DataFrame:
    return defined.join(used.select("path", "key").distinct(), ["path", "key"], "left_anti")


def system_resource(key: Column) -> Column:
    return F.lower(key).rlike(r"^(system|\{x:static|\{dynamicresource)") | key.rlike("Brush|Color|Font|Theme")


def missing_resources(defined: DataFrame, used: DataFrame) -> DataFrame:
    """Static references whose key nothing defines, ignoring case; system resources are exempt."""
    known = defined.select("path", names.fold_ci("key").alias("_key")).distinct()
    return used.where(F.col("is_static") & ~system_resource(F.col("key"))).withColumn("_key", names.fold_ci("key")).join(known, ["path", "_key"], "left_anti").drop("_key")


def typos(attrs: DataFrame) -> DataFrame:
    """Attributes that are known misspellings, with the correction."""
    corrections = F.create_map(*[F.lit(x) for pair in TYPOS.items() for x in (names.fold_text(pair[0]), pair[1])])
    return attrs.withColumn("correction", F.element_at(corrections, names.fold_ci("name"))).where("correction is not null")


def issues(rows: DataFrame, known_types: DataFrame | None = None) -> DataFrame:
    """All rules over parsed elements: path, line, code, severity, message."""

    def issue(df: DataFrame, code: str, severity: str, message: Column) -> DataFrame:
        return df.select("path", "line", F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))

    attrs = attributes(rows)
    bound, used, defined = bindings(attrs), resource_references(attrs), resources(attrs)
    named = named_elements(attrs)
    out = [
        issue(rows.where("error is not null"), "XAML001", "Error", F.col("error")),
        issue(bound.where(F.col("mode").isNotNull() & ~names.fold_ci("mode").isin([names.fold_text(m) for m in MODES])), "XAML002", "Error", F.concat(F.lit("Invalid binding mode "), "mode")),
        issue(typos(attrs), "XAML003", "Warning", F.concat(F.lit("Did you mean "), "correction")),
        issue(bound.where("binding_path is null and element_name is null"), "XAML004", "Warning", F.lit("Empty binding path")),
        issue(missing_resources(defined, used), "XAML005", "Warning", F.concat(F.lit("Unknown resource "), "key")),
        issue(repeated_after_first(named, [F.col("path"), names.fold_ci("name")], [F.col("line"), F.col("col")]), "XAML006", "Error", F.concat(F.lit("Duplicate name "), "name")),
    ]
    if known_types is not None:
        elements_ = rows.where(F.col("error").isNull() & ~F.col("name").contains("."))
        out.append(issue(elements_.join(known_types.select(F.col("name")).distinct(), "name", "left_anti"), "XAML007", "Warning", F.concat(F.lit("Unknown type "), "name")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def binding_errors(bound: DataFrame, named: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """path, line, severity, problem, subject of bindings to element names that no element has, to converters that are no resource
    of the file (where defined, the resources, is given), of suspicious paths, and of modes without a path."""

    def error(rows: DataFrame, severity: str, problem: str, subject: str) -> DataFrame:
        return rows.select("path", "line", F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), F.col(subject).alias("subject"))

    p = F.col("binding_path")
    elements_ = named.select("path", F.col("name").alias("element_name")).distinct()
    out = error(bound.where("element_name is not null").join(elements_, ["path", "element_name"], "left_anti"), "ERROR", "unknown element", "element_name")
    if defined is not None:
        keys = defined.select("path", F.col("key").alias("converter")).distinct()
        out = out.unionByName(error(bound.where("converter is not null").join(keys, ["path", "converter"], "left_anti"), "WARNING", "unknown converter", "converter"))
    for test, severity, problem, subject in (
        (p.contains(".."), "WARNING", "suspicious path", "binding_path"),
        (p.endswith("."), "ERROR", "path ends with a dot", "binding_path"),
        (p.startswith("[") & ~p.contains("]"), "ERROR", "unclosed indexer", "binding_path"),
        (p.isNull() & F.col("element_name").isNull() & F.col("mode").isNotNull(), "WARNING", "mode without path", "mode"),
    ):
        out = out.unionByName(error(bound.where(test), severity, problem, subject))
    return out


def namespaces(rows: DataFrame) -> DataFrame:
    """path, prefix (empty for the default one), uri and clr_namespace (null where there is none) that the root elements declare."""
    root = rows.where("depth = 0 and error is null").select("path", F.explode("attributes").alias("a")).where(F.col("a.name").rlike("^xmlns(:|$)"))
    uri = F.col("a.value")
    named = F.regexp_extract(uri, r"clr-namespace:([^;]+)", 1)
    known = F.element_at(F.create_map(*[F.lit(x) for pair in CLR_NAMESPACES.items() for x in pair]), uri)
    return root.select("path", F.regexp_replace("a.name", "^xmlns:?", "").alias("prefix"), uri.alias("uri"), F.when(named != "", F.trim(named)).otherwise(known).alias("clr_namespace"))


def element_types(rows: DataFrame) -> DataFrame:
    """path, id, name, type_name and clr_namespace of each element, by the prefix of its name."""
    own = rows.where("error is null").withColumn("prefix", F.when(F.col("name").contains(":"), F.substring_index("name", ":", 1)).otherwise(""))
    return own.join(namespaces(rows).select("path", "prefix", "clr_namespace"), ["path", "prefix"], "left").select("path", "id", "name", F.substring_index("name", ":", -1).alias("type_name"), "clr_namespace")


def tree(rows: DataFrame, max_depth: int) -> DataFrame:
    """Elements down to max_depth without property elements (Owner.Property)."""
    return rows.where((F.col("depth") <= max_depth) & ~F.col("name").contains(".") & F.col("error").isNull())


def property_type(name: Column) -> Column:
    return (
        F.when(name.endswith("Command"), "ICommand")
        .when(name.rlike("Items|Collection|List"), "IEnumerable<object>")
        .when(name.rlike("^(Is|Has|Can)|Enabled|Visible"), "bool")
        .when(name.rlike("Count|Index|Number"), "int")
        .when(name.rlike("Date|Time"), "DateTime")
        .otherwise("object")
    )


def view_model(bound: DataFrame, root: str = "binding_path") -> DataFrame:
    """Property and type of the first segment of each binding path; the last binding that says more than object wins."""
    own = bound.where(F.col(root).isNotNull()).select(F.substring_index(root, ".", 1).alias("property"), "seq").withColumn("type", property_type(F.col("property")))
    return own.groupBy("property").agg(F.max_by("type", F.struct((F.col("type") != "object").cast("int"), "seq")).alias("type"))


def recovered(files: DataFrame) -> DataFrame:
    """Class, names and bindings of texts that don't parse, by pattern."""
    c = F.col("content")
    full = F.regexp_extract(c, r'x:Class="([^"]+)"', 1)
    return files.select(
        "path", F.substring_index(full, ".", -1).alias("class_name"), F.regexp_extract(full, r"^(.+)\.[^.]*$", 1).alias("namespace"),
        F.regexp_extract_all(c, F.lit(r'x:Name="([^"]+)"'), 1).alias("names"), F.regexp_extract_all(c, F.lit(BINDING), 1).alias("bindings"),
    )


def interface_text(model: DataFrame, name: str) -> DataFrame:
    """One row: an interface with a property for each row of model, in order of name. The model of one view is small by nature."""
    line = F.concat(F.lit("    "), "type", F.lit(" "), "property", F.lit(" { get; }"))
    return model.agg(F.concat(F.lit(f"public interface {name}\n{{\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n}")).alias("text"))

