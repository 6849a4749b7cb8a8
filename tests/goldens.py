"""Small CSV files with the results they must give."""

NAMES = [
    "Ana García", "Carlos López", "María Rodríguez", "José Martínez", "Laura Hernández", "Pedro Sánchez",
    "Sofía Ramírez", "Diego Torres", "Valentina Flores", "Andrés Morales", "Camila Vargas", "Felipe Rojas",
    "Isabella Castro", "Mateo Ortiz", "Luciana Mendoza", "Sebastián Ruiz", "Gabriela Peña", "Nicolás Herrera",
    "Antonella Silva", "Emiliano Díaz",
]
DEPARTMENTS = ["Ventas", "Ingeniería", "Marketing", "Finanzas"]


def _clean(i, day=None):
    return [str(i + 1), NAMES[i], f"u{i}@empresa.com", DEPARTMENTS[i % 4], day or f"2024-01-{i + 1:02}"]


def _csv(header, rows):
    return "\n".join([header, *[",".join(r) for r in rows]]) + "\n"


def low():
    return _csv("id,nombre,correo,departamento,fecha_actualizacion", [_clean(i) for i in range(20)])


def medium():
    rows = [_clean(i) for i in range(19)]
    rows[2][2] = rows[7][2] = ""
    rows[3][3] = rows[11][3] = ""
    rows[5][4], rows[12][4], rows[14][4], rows[17][4] = "2024-02-29", "2024-04-30", "15/01/2024", "01-02-2024"
    return _csv("id,nombre,correo,departamento,fecha_actualizacion", [*rows, rows[4]])


def high():
    states = ["pendiente", "en-revision", "sin-datos", "completo", "aprobado", "rechazado", "parcial"]
    rows = [[*_clean(i)[:4], states[i % 7]] for i in range(15)]
    for i in [1, 2, 3, 7, 10]:
        rows[i][2] = ""
    for i in [2, 4, 5, 6, 8, 9, 11]:
        rows[i][3] = ""
    return _csv("id,nombre,correo,departamento,registro", [rows[0]] * 5 + rows)


LOCAL = """id,nombre,updated_at
1,Alice,2024-01-15
2,Bob,2024-02-20
3,,2024-13-01
1,Alice,2024-01-15
4,Diana,
5,Eva,not-a-date
6,Frank,2024-03-10
7,Grace,2024-04-05
8,Henry,2024-05-12
9,Irene,2024-06-18"""

ENRICH = "\n".join(LOCAL.split("\n")[:7])

GOLDENS = {
    "low": (low(), [], (0, 0), [("fecha_actualizacion", "incremental_marker", "alta"), ("id", "primary_key", "alta")]),
    "medium": (
        medium(),
        [("empties-correo", 2, 10.0, "medio"), ("empties-departamento", 2, 10.0, "medio"),
         ("duplicates-exact", 1, 5.0, "medio")],
        (30, 30),
        [("fecha_actualizacion", "incremental_marker", "alta")],
    ),
    "high": (
        high(),
        [("empties-correo", 5, 25.0, "alto"), ("empties-departamento", 7, 35.0, "alto"),
         ("duplicates-exact", 5, 25.0, "alto")],
        (60, 60),
        [],
    ),
    "local": (
        LOCAL,
        [("empties-nombre", 1, 10.0, "medio"), ("empties-updated_at", 1, 10.0, "medio"),
         ("duplicates-exact", 1, 10.0, "medio"), ("invalid_dates-updated_at", 2, 20.0, "alto")],
        (50, 50),
        [("updated_at", "incremental_marker", "media")],
    ),
    "enrich": (
        ENRICH,
        [("empties-nombre", 1, 16.7, "medio"), ("empties-updated_at", 1, 16.7, "medio"),
         ("duplicates-exact", 1, 16.7, "medio"), ("invalid_dates-updated_at", 2, 33.3, "alto")],
        (50, 50),
        [("updated_at", "incremental_marker", "media")],
    ),
}

TYPES = {
    "low": ["number", "string", "string", "string", "date"],
    "medium": ["number", "string", "string", "string", "mixed"],
    "high": ["number", "string", "string", "string", "string"],
    "local": ["number", "string", "mixed"],
    "enrich": ["number", "string", "mixed"],
}
