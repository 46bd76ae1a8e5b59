"""Markup parsing and rules."""

from graphloom import schema
from graphloom.operators import markup
from graphloom.plans.workspace import Workspace

VIEW = """<Window x:Class="MyApp.MainWindow" xmlns="p" xmlns:x="x">
  <Window.Resources><Style x:Key="ButtonStyle" /><Style x:Key="Unused" /></Window.Resources>
  <TextBlock x:Name="a" Text="{Binding UserName}" />
  <TextBlock x:Name="a" Text="{Binding Path=Status, Mode=OneWay}" Grid.Row="1" Visibilty="x" />
  <Button Style="{StaticResource ButtonStyle}" Foreground="{DynamicResource TextBrush}" Command="{Binding SaveCommand}" />
  <Slider Value="{Binding Value, ElementName=slider}" Tag="{Binding}" Other="{StaticResource Nowhere}" Bad="{Binding X, Mode=Sometimes}" />
</Window>"""


def workspace(spark):
    return Workspace(files=spark.createDataFrame([("v.xaml", VIEW), ("broken.xaml", '<Window x:Class="A.B">\n<Button></Window>')], schema.FILES))


def test_bindings_and_resources(spark):
    got = {(r.binding_path, r.mode, r.element_name) for r in workspace(spark).markup_bindings().collect()}
    assert got == {("UserName", None, None), ("Status", "OneWay", None), ("SaveCommand", None, None), ("Value", None, "slider"), (None, None, None), ("X", "Sometimes", None)}
    _, used, unused = workspace(spark).markup_resources()
    assert {(r.key, r.is_static) for r in used.collect()} == {("ButtonStyle", True), ("TextBrush", False), ("Nowhere", True)}
    assert [r.key for r in unused.collect()] == ["Unused"]


def test_rules(spark):
    got = sorted((r.path, r.line, r.code) for r in workspace(spark).markup_issues().collect())
    assert got == [("broken.xaml", 2, "XAML001"), ("v.xaml", 4, "XAML003"), ("v.xaml", 4, "XAML006"), ("v.xaml", 6, "XAML002"), ("v.xaml", 6, "XAML004"), ("v.xaml", 6, "XAML005")]
    assert [(r.problem, r.subject) for r in workspace(spark).binding_errors().collect()] == [("unknown element", "slider")]


def test_names_structure_and_model(spark):
    ws = workspace(spark)
    assert [(r.name, r.n, r.lines) for r in ws.markup_names().collect()] == [("a", 2, [3, 4])]
    assert "Window.Resources" not in {r.name for r in ws.markup_structure(1).collect()}
    assert ws.view_model("IMain").first().text == "public interface IMain\n{\n    ICommand SaveCommand { get; }\n    object Status { get; }\n    object UserName { get; }\n    object Value { get; }\n    object X { get; }\n}"


def test_attached_and_recovered(spark):
    attrs = markup.attributes(markup.elements(spark.createDataFrame([("v.xaml", VIEW)], schema.FILES)))
    assert [(r.owner_type, r.property_name, r.value) for r in attrs.where("is_attached").collect()] == [("Grid", "Row", "1")]
    got = markup.recovered(spark.createDataFrame([("b", '<Window x:Class="MyApp.MainWindow"><Button>')], schema.FILES)).first()
    assert (got.class_name, got.namespace) == ("MainWindow", "MyApp")


NESTED = """<Page xmlns="http://schemas.microsoft.com/winfx/2006/xaml/presentation" xmlns:x="x" xmlns:local="clr-namespace:Shop.Views;assembly=Shop">
  <Page.Resources><local:Upper x:Key="Upper" /></Page.Resources>
  <local:Card Title="{Binding Converter={StaticResource Upper}, Path=Name, Mode=twoway}" Note="{Binding Path=A, Converter={StaticResource Absent, Path=Z}, RelativeSource={RelativeSource Self}}" />
  <TextBlock A="{Binding Items[0].Name}" B="{Binding Path=a..b}" C="{Binding Path=a.}" D="{Binding Path=[0}" E="{Binding Mode=OneWay}" F="{Binding Path=X, Source={x:Static local:Card.All}}" />
</Page>"""


def test_nested_extensions(spark):
    ws = Workspace(files=spark.createDataFrame([("n.xaml", NESTED)], schema.FILES))
    got = [(r.binding_path, r.mode, r.converter) for r in ws.markup_bindings().where("line < 4").orderBy("element_id", "name").collect()]
    assert sorted(got, key=str) == [("A", None, "{StaticResource Absent, Path=Z}"), ("Name", "twoway", "Upper")] or sorted(got, key=str) == [("A", None, "Absent, Path=Z"), ("Name", "twoway", "Upper")]
    assert {r.code for r in ws.markup_issues().collect()} == {"XAML004", "XAML005"}  # a mode's case doesn't matter; the empty path and the absent resource do
    errors = {(r.problem, r.subject) for r in ws.binding_errors().where("line > 3").collect()}
    assert errors == {("suspicious path", "a..b"), ("path ends with a dot", "a."), ("unclosed indexer", "[0"), ("mode without path", "OneWay")}
    assert [r.problem for r in ws.binding_errors().where("line = 3").collect()] == ["unknown converter"]


def test_namespaces_and_recovery(spark):
    ws = Workspace(files=spark.createDataFrame([("n.xaml", NESTED), ("bad.xaml", '<Page x:Class="Shop.Main" x:Name="m"><A')], schema.FILES))
    types = {(r.type_name, r.clr_namespace) for r in ws.markup_types().collect()}
    assert {("Card", "Shop.Views"), ("TextBlock", "System.Windows.Controls"), ("Upper", "Shop.Views")} <= types
    assert [(r.path, r.class_name, r.names) for r in ws.markup_recovered().collect()] == [("bad.xaml", "Main", ["m"])]
