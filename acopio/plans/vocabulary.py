"""The vocabulary of the catalogue, as Turtle."""

# Names of classes and properties, and what defines a class.
VOCABULARY = """
@prefix : <urn:catalogue#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .

:ProductoPerecedero rdfs:subClassOf :Producto ; owl:equivalentClass [ owl:intersectionOf ( :Producto [ owl:onProperty :perecedero ; owl:hasValue true ] ) ] .
:ProductoAltaRotacion rdfs:subClassOf :Producto ; owl:equivalentClass [ owl:intersectionOf ( :Producto [ owl:onProperty :altaRotacion ; owl:hasValue true ] ) ] .
:ProductoColdStart rdfs:subClassOf :Producto ; owl:equivalentClass [ owl:intersectionOf ( :Producto [ owl:onProperty :tieneHistorial ; owl:hasValue false ] ) ] .
:ProductoCritico rdfs:subClassOf :Producto ; owl:equivalentClass [ owl:intersectionOf ( :Producto [ owl:unionOf ( :ProductoPerecedero :ProductoAltaRotacion ) ] ) ] .
:ProveedorExterior rdfs:subClassOf :Proveedor ; owl:equivalentClass [ owl:intersectionOf ( :Proveedor [ owl:onProperty :esExterior ; owl:hasValue true ] ) ] .
:ProveedorLocal rdfs:subClassOf :Proveedor ; owl:equivalentClass [ owl:intersectionOf ( :Proveedor [ owl:onProperty :esExterior ; owl:hasValue false ] ) ] .
:AlgorithmRecommendation rdfs:subClassOf :Decision .
:Prohibition rdfs:subClassOf :Norm . :Obligation rdfs:subClassOf :Norm . :Permission rdfs:subClassOf :Norm .
:Producto owl:disjointWith :Proveedor . :Decision owl:disjointWith :Algorithm . :ProveedorLocal owl:disjointWith :ProveedorExterior .
[] a owl:AllDisjointClasses ; owl:members ( :Obligation :Permission :Prohibition ) .

:perecedero rdfs:domain :Producto ; rdfs:range xsd:boolean .
:altaRotacion rdfs:domain :Producto ; rdfs:range xsd:boolean .
:tieneHistorial rdfs:domain :Producto ; rdfs:range xsd:boolean .
:esExterior rdfs:domain :Proveedor ; rdfs:range xsd:boolean .
:perteneceA a owl:TransitiveProperty .
:suministradoPor rdfs:domain :Producto ; rdfs:range :Proveedor ; owl:inverseOf :suministra .
:proveedorPrincipal rdfs:subPropertyOf :suministradoPor .
:similarA a owl:SymmetricProperty ; rdfs:domain :Producto ; rdfs:range :Producto .
"""

#: The classes whose members follow from axioms.
DERIVED = ("ProductoCritico", "ProductoPerecedero", "ProductoAltaRotacion", "ProductoColdStart", "ProveedorExterior", "ProveedorLocal")
