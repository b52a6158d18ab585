"""The sentences of alerts and advice, by a short name."""

# Wording of alerts, recommendations and findings, in the language of the reports.
TEXT = {
    "demanda_extrema_predicha_llamadas": "Demanda extrema predicha: %.1f llamadas (>+2.5σ histórico)",
    "activar_protocolo_emergencia_personal": "Activar protocolo de emergencia, personal adicional urgente",
    "alta_demanda_predicha_llamadas": "Alta demanda predicha: %.1f llamadas (>+1.5σ histórico)",
    "programar_personal_adicional_revisar": "Programar personal adicional, revisar capacidad",
    "baja_demanda_predicha_llamadas": "Baja demanda predicha: %.1f llamadas (<-1.5σ histórico)",
    "considerar_reducir_turnos_o": "Considerar reducir turnos o reasignar personal",
    "alta_incertidumbre_llamadas_prediccion": "Alta incertidumbre: ±%.1f llamadas (%s%% de la predicción)",
    "monitorear_cerca_mantener_personal": "Monitorear de cerca, mantener personal de contingencia",
    "lunes_demanda_alta_llamadas": "Lunes con demanda alta: %.1f llamadas (efecto post-weekend)",
    "reforzar_equipo_lunes_preparar": "Reforzar equipo de lunes, preparar gestión de cola",
    "tendencia_creciente_sostenida_proximos": "Tendencia creciente sostenida en próximos 5 días",
    "revisar_capacidad_siguiente_semana": "Revisar capacidad para siguiente semana",
    "calidad_datos_baja": "Calidad de datos baja (%.1f/100)",
    "implementar_validacion_datos_origen": "Implementar validación de datos en origen y limpieza automatizada",
    "alta_variabilidad_diaria": "Alta variabilidad diaria (%.3f)",
    "usar_modelos_que_manejen": "Usar modelos que manejen bien la variabilidad (ARIMA, ensemble methods)",
    "multiples_dias_volumenes_atipicos": "Múltiples días con volúmenes atípicos",
    "implementar_deteccion_tratamiento_automatico": "Implementar detección y tratamiento automático de outliers",
    "fuerte_patron_horario_no": "Fuerte patrón horario no capturado",
    "agregar_regresores_horarios_usar": "Agregar regresores horarios y usar modelos con estacionalidad múltiple",
    "llamadas_sin_clasificar": "%.1f%% de llamadas sin clasificar",
    "revisar_campos_adicionales_origen": "Revisar campos adicionales de origen para mejorar clasificación",
    "desbalance_entre_tipos_ratio": "Desbalance entre tipos: ratio %.1f",
    "crear_modelos_separados_cada": "Crear modelos separados para cada tipo de llamada",
    "confianza_segmentacion_baja": "Confianza de segmentación baja (%.2f)",
    "validar_manualmente_una_muestra": "Validar manualmente una muestra y ajustar reglas de clasificación",
    "alto_volumen_feriados_programar": "Alto volumen en feriados (%.1f%%): Programar personal adicional",
    "considerar_incentivos_especiales_feriados": "Considerar incentivos especiales para feriados",
    "monitorear_cerca_calidad_servicio": "Monitorear de cerca la calidad de servicio",
    "baja_actividad_feriados_oportunidad": "Baja actividad en feriados (%.1f%%): Oportunidad para capacitación",
    "ideal_mantenimiento_sistemas": "Ideal para mantenimiento de sistemas",
    "programar_entrenamientos_especializados": "Programar entrenamientos especializados",
    "actividad_moderada_feriados_mantener": "Actividad moderada en feriados (%.1f%%): Mantener staff regular",
    "monitorear_tendencias_estacionales": "Monitorear tendencias estacionales",
    "cargo_alto_volumen_priorizar": "Cargo de alto volumen: Priorizar en análisis",
    "implementar_metricas_especificas_performance": "Implementar métricas específicas de performance",
    "rol_liderazgo_coordinar_equipos": "Rol de liderazgo: Coordinar equipos en feriados",
    "planificar_horarios_especiales": "Planificar horarios especiales",
    "personal_operativo_evaluar_rotacion": "Personal operativo: Evaluar rotación en feriados",
    "considerar_turnos_flexibles": "Considerar turnos flexibles",
    "soporte_administrativo_backup_feriados": "Soporte administrativo: Backup en feriados críticos",
    "mae_critico": "MAE crítico de ",
    "revisar_inmediatamente_calidad_datos": "Revisar inmediatamente calidad de datos y modelos",
    "solo_modelos_activos": "Solo %d modelos activos en %s",
    "verificar_entrenamiento_modelos_adicionales": "Verificar entrenamiento de modelos adicionales",
    "alertas_criticas_predicciones": "%d alertas críticas en predicciones de %s",
    "revisar_configuracion_umbrales_capacidad": "Revisar configuración de umbrales y capacidad operativa",
    "degradacion_performance_general": "Degradación de %.1f%% en performance general",
    "investigar_causas_degradacion_reentrenar": "Investigar causas de degradación y reentrenar modelos",
    "sistema_estado": "Sistema en estado ",
    "revision_completa_sistema_requerida": "Revisión completa del sistema requerida",
    "performance_descendente_durante_semana": "Performance descendente durante la semana",
    "investigar_causas_degradacion_planificar": "Investigar causas de degradación y planificar mejoras",
    "errores_recientes_detectados": " errores recientes detectados",
    "revisar_logs_fortalecer_monitoreo": "Revisar logs y fortalecer monitoreo preventivo",
    "mantener_excelencia_operativa": "Mantener Excelencia Operativa",
    "sistema_funcionando_optimamente_mantener": "Sistema funcionando óptimamente. Mantener rutinas de monitoreo.",
    "intervencion_inmediata_requerida": "Intervención Inmediata Requerida",
    "performance_debajo_estandares_minimos": "Performance por debajo de estándares mínimos. Requiere revisión completa.",
    "mejorar_predicciones": "Mejorar Predicciones ",
    "requiere_optimizacion": " requiere optimización",
    "sin_resultados": "Sin resultados para ",
    "performance_baja": "Performance baja en ",
}
